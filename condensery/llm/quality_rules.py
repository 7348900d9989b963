"""Quality rules: base counts, and a log-likelihood ratio of hashed n-grams between trusted and raw text.

All of it is DataFrame expressions. A text's n-grams are its lower-case words, its surface forms (words with long letter runs as one letter of
their case and digits as one digit, which stay dense whatever the vocabulary) and the bigrams of those forms, hashed to ``BUCKETS`` classes.
Two multinomials over these classes are counted in one pass: the raw corpus (every document) and the trusted
target (documents that a bounded sample of labels marks as good). A document's score is the mean over its n-grams
of log p_target - log p_raw; it is kept when the score is at least ``THRESHOLD``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Hashed n-gram classes: the size of what is sent to every task (one double each).
BUCKETS = 1 << 15
#: Expected number of trusted rows that the target multinomial uses; bounds the broadcast of their ids.
TRUSTED_ROWS = 16_000
#: Mean log-likelihood ratio below which a document goes.
THRESHOLD = -0.2
#: N-grams, spread as in the raw corpus, that are added to the target's: what the target has not seen scores log(PRIOR / (PRIOR + its n-grams)).
PRIOR = 1024

SPACE = r"[\x20\x09-\x0D]+"
LOWER, UPPER = "a-zß-öø-ÿ", "A-ZÀ-ÖØ-Þ"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def surface(text: Column) -> Column:
    """Words as forms: lower-case runs of four letters or more become ``a``, upper-case runs ``A``, digits ``0``."""
    folded = F.regexp_replace(text, f"[{LOWER}]{{4,}}", "a")
    folded = F.regexp_replace(folded, f"[{UPPER}]+", "A")
    return words(F.regexp_replace(folded, "[0-9]+", "0"))


def ngram_classes(w: Column, forms: Column, buckets: int) -> Column:
    """The hashed class of each lower-case word, of each form, and of each form with the one before it (for the first, a begin mark)."""
    place = lambda *x: F.pmod(F.xxhash64(*x), F.lit(buckets)).cast("int")
    pair = lambda f, i: place(F.lit(3), f, F.coalesce(F.get(forms, i - 1), F.lit("^")))
    return F.concat(F.transform(w, lambda x: place(F.lit(1), F.lower(x))), F.transform(forms, lambda f: place(F.lit(2), f)), F.transform(forms, pair))


def base_counts(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, its words (w) and the base counts of each whole text; a null text has no words and no lines.

    ``carried``: further columns of ``docs`` to hand on.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    w = F.col("w")
    n = F.size(w)
    x = docs.select("doc_id", text.alias("text"), *carried).withColumn("w", words(F.col("text")))
    triples = F.when(n >= 3, F.transform(F.slice(w, F.lit(1), n - 2), lambda a, i: F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    x = x.withColumns({"lines": lines, "t": triples})
    x = x.withColumn("has", F.size(F.array_distinct("t")) < F.size("t"))
    # Only a text with a repeated window needs its windows sorted, with their places.
    x = x.withColumn("s", F.when(F.col("has"), F.sort_array(F.transform("t", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("s")
    twice = F.filter(
        F.transform(s, lambda y, i: F.struct(y["i"].alias("i"), (y["h"].eqNullSafe(F.get(s, i - 1)["h"]) | y["h"].eqNullSafe(F.get(s, i + 1)["h"])).alias("r"))),
        lambda y: y["r"],
    )
    x = x.withColumn("r", F.when(F.col("has"), F.sort_array(F.transform(twice, lambda y: y["i"]))))
    r = F.col("r")
    # Words from each repeated window's first up to the next repeated window, three at most.
    covered = F.aggregate(F.transform(r, lambda p, i: F.least(F.coalesce(F.get(r, i + 1), F.lit(2**30)) - p, F.lit(3))), F.lit(0), lambda acc, y: acc + y)
    without = F.col("text")
    for sign in "#*$%&|<>":
        without = F.replace(without, F.lit(sign), F.lit(""))
    return x.select(
        "doc_id", "text", "w", *carried,
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.octet_length("text") - F.octet_length(without)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("has"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """Ids of about ``rows`` documents labelled good, chosen by a hash of the id; all of them where there are fewer."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    n = good.count()
    share = min(1.0, rows / max(1, n))
    return good.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))


def ratio_table(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> list[float]:
    """log p_target - log p_raw of each hashed class. The counts cover every document; ``buckets`` bounds the result."""
    good = trusted.withColumn("good", F.lit(1))
    text = F.coalesce(F.col("text"), F.lit(""))
    # The list of trusted ids is bounded. It meets documents, before their n-grams are rows.
    marked = docs.select("doc_id", text.alias("text")).join(F.broadcast(good), "doc_id", "left").select("good", words(F.col("text")).alias("w"), surface(F.col("text")).alias("forms"))
    # Outer, as else the optimizer filters by the size of the array, and works it out once more for that.
    classes = marked.select("good", F.explode_outer(ngram_classes(F.col("w"), F.col("forms"), buckets)).alias("c")).filter("c IS NOT NULL")
    counts = classes.groupBy("c").agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("target")).collect()
    all_raw, all_target = sum(row["raw"] for row in counts), sum(row["target"] for row in counts)
    table = [0.0] * buckets
    for row in counts:
        table[row["c"]] = round(math.log((row["target"] * all_raw / row["raw"] + prior) / (all_target + prior)), 9)
    return table


def quality_verdicts(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD, trusted_rows: int = TRUSTED_ROWS, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, llr (mean log ratio per n-gram), kept.

    A null or empty text has no words, fails the base rule and has llr 0. Without trusted rows the two
    multinomials are equal and every llr is 0. Repeated rows are judged one by one. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text", *carried)
    table = ratio_table(docs, trusted_ids(labels, trusted_rows), buckets)
    weights = F.from_json(F.lit("[" + ",".join(map(repr, table)) + "]"), "array<double>")
    counted = base_counts(docs, carried)
    counted = counted.withColumn("forms", surface(F.col("text"))).withColumn("classes", ngram_classes(F.col("w"), F.col("forms"), buckets))
    total = F.aggregate("classes", F.lit(0.0), lambda acc, c: acc + F.get(weights, c))
    judged = counted.withColumn("llr", F.when(F.col("n_words") > 0, total / F.size("classes")).otherwise(F.lit(0.0))).drop("text", "w", "forms", "classes")
    # Not deterministic to the optimizer, so that a filter on the verdict isn't pushed below the columns it is worked out from
    # (it would work them out many times over).
    once = F.spark_partition_id() >= 0
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", once & ~failed & (F.col("llr") >= threshold))


def keep_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``; a filter without a shuffle."""
    whole = docs.select("doc_id", "text", F.struct("*").alias("_doc"))
    return quality_verdicts(whole, labels, carried=("_doc",), **options).filter("kept").select("_doc.*")
