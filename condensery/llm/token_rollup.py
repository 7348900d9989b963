"""Token-count rollups maintained by deltas.

A ledger is a Parquet table of signed sums by source, language and tokenizer version, one partition for each committed batch, and in it a marker row. A batch
is written by dynamic partition overwrite, so committing it again (after a lost driver, say) leaves the same totals. ``compact`` folds the
committed batches into one base partition that lists their ids as rows: totals then read the base and the batches since, and a folded batch can't be committed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KEYS = ["source", "lang", "tokenizer"]
MEASURES = ["docs", "tokens"]
#: What the id of a base begins with.
BASE = "base-"


def changes(docs: DataFrame, tokens: Column, tokenizer: str, sign: int = 1) -> DataFrame:
    """Signed change rows of documents: inserts (sign 1) or deletes (sign -1). A null text has no tokens."""
    return docs.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("docs"), (sign * F.coalesce(tokens, F.lit(0))).cast("long").alias("tokens"))


def revisions(docs: DataFrame, before: Column, after: Column, tokenizer: str) -> DataFrame:
    """Change rows of documents whose counts are revised: no document comes or goes, the tokens change by the difference."""
    return docs.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(0).cast("long").alias("docs"), (F.coalesce(after, F.lit(0)) - F.coalesce(before, F.lit(0))).cast("long").alias("tokens"))


class Ledger:
    """Rollups at ``path``, which one writer at a time commits to and compacts; readers may be many. Null keys are a group of their own. Each batch has one marker row (docs and tokens 0), so an
    empty batch is committed too, and takes the place of what it had before. Rows may have other columns, batch among them; they are left out. A ledger without batches can't be read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def commit(self, batch: str, rows: DataFrame) -> None:
        """Write a batch's sums; committing the same batch again replaces it, and does nothing once it is folded into a base: that commit has taken effect.
        Sums are taken before and after the shuffle, so a hot source costs each task one row."""
        if batch.startswith(BASE):
            raise ValueError(f"the id of a batch may not begin with {BASE!r}")
        if self.exists() and not self.folded(self.base()).filter(F.col("folded") == batch).isEmpty():
            return
        self.write(batch, rows.groupBy(*KEYS).agg(*(F.sum(m).alias(m) for m in MEASURES)))

    def write(self, batch: str, sums: DataFrame, folded: DataFrame | None = None) -> None:
        nothing = [*(F.lit(None).cast("string").alias(k) for k in KEYS), *(F.lit(0).cast("long").alias(m) for m in MEASURES)]
        both = sums.select(*KEYS, *MEASURES, F.lit(None).cast("string").alias("folded")).unionByName(self.spark.range(1).select(*nothing, F.lit(None).cast("string").alias("folded")))
        both = both if folded is None else both.unionByName(folded.select(*nothing, "folded"))
        both.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"{', '.join(f'{k} string' for k in KEYS)}, {', '.join(f'{m} long' for m in MEASURES)}, folded string, batch string").parquet(self.path)

    def exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def base(self) -> str | None:
        """The newest base's id; a base's partition counts from the moment it is whole, so a compaction that dies changes nothing."""
        return self.rows().filter(F.col("batch").startswith(BASE)).agg(F.max("batch")).first()[0] if self.exists() else None

    def folded(self, base: str | None) -> DataFrame:
        """(folded): the batches and bases that ``base`` holds, as rows of its partition."""
        return self.rows().filter((F.col("batch") == F.lit(base)) & F.col("folded").isNotNull()).select("folded")

    def since(self, base: str | None) -> DataFrame:
        """Rows of ``base`` and of the batches that it doesn't hold."""
        live = self.rows().filter(F.coalesce(~F.col("batch").startswith(BASE) | (F.col("batch") == F.lit(base)), F.lit(True)))
        return live.join(self.folded(base).withColumnRenamed("folded", "_held"), F.col("batch") == F.col("_held"), "left_anti")

    def current(self) -> DataFrame:
        return self.since(self.base())

    def pending(self) -> list[str]:
        """The newest base and the batches committed since, which the next base is made of: as many as since the last compaction."""
        return sorted(r["batch"] for r in self.current().select("batch").distinct().collect())

    def compact(self) -> None:
        """Fold the base and all batches since into a new base."""
        self.fold(self.pending())

    def fold(self, ids: list[str]) -> None:
        """Fold exactly these into a new base: what is committed meanwhile is neither summed nor listed."""
        base = self.base()
        taken = self.rows().filter(F.col("batch").isin(*ids))
        held = self.folded(base).unionByName(self.spark.createDataFrame([(i,) for i in ids], "folded string"))
        number = int(base.removeprefix(BASE)) + 1 if base else 1
        self.write(f"{BASE}{number:012}", taken.groupBy(*KEYS).agg(*(F.sum(m).alias(m) for m in MEASURES)), held)

    def vacuum(self) -> None:
        """Delete the partitions that the newest base holds, for when no reader is under way; their ids stay known."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        there = self.rows().select("batch").distinct().join(self.folded(self.base()).withColumnRenamed("folded", "batch"), "batch", "left_semi")
        for row in there.toLocalIterator():
            name = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(row["batch"])
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(place, f"batch={name}"), True)

    def totals(self) -> DataFrame:
        """Current totals; groups whose documents have all gone are left out."""
        sums = self.current().groupBy(*KEYS).agg(*(F.sum(m).alias(m) for m in MEASURES))
        return sums.filter((F.col("docs") != 0) | (F.col("tokens") != 0))


def whitespace_tokens() -> Column:
    """Tokenizer version words-v1: runs between white space."""
    return F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))


def piece_tokens() -> Column:
    """Tokenizer version pieces-v2: runs of letters and digits, and every other visible character."""
    return F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"))
