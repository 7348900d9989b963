"""Registered queries of the compression library over the given tables, with the SQL that gives the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..functions.dims import CONTEXT_WINDOWS, PRESETS, PRICES, STOP_WORDS
from ..functions.storage import written
from ..operators import chunking, diffs, graph, leaderboard as board, reports, selection, sessions, similarity, structural
from ..streaming.logs import collapse_stream
from . import compress as C

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def prose(spark: SparkSession, d: str) -> DataFrame:
    """The documents' chunks, written, for steps that read them more than once."""
    return written(chunking.prose_chunks(documents(spark, d)), "chunks")


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """Log lines of each day and hour, from events; every tenth event is an error with a second line."""
    e = spark.read.parquet(f"{d}/events.parquet")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    level = F.when(F.col("event_id") % 10 == 0, "ERROR").when(F.col("event_id") % 10 < 3, "WARN").otherwise("INFO")
    head = F.concat_ws(" ", stamp, level, "event_type", F.concat(F.lit("value="), F.floor("value").cast("string")))
    body = F.when(F.col("event_id") % 10 == 0, F.array(head, F.concat(F.lit("  at handler."), "event_type"))).otherwise(F.array(head))
    x = e.select(F.date_format("ts", "yyyy-MM-dd HH").alias("doc_id"), (F.row_number().over(hour_window()) - 1).alias("n"), body.alias("body"))
    return x.select("doc_id", "n", F.posexplode("body").alias("k", "text")).select("doc_id", (F.col("n") * 2 + F.col("k")).cast("int").alias("idx"), "text")


def hour_window():
    from pyspark.sql import Window

    return Window.partitionBy(F.date_format("ts", "yyyy-MM-dd HH")).orderBy("ts", "event_id")


def code_files(spark: SparkSession, d: str) -> DataFrame:
    """One small Python file for each brand and size: a function for each part, some calling the one before or a part of the next size."""
    p = spark.read.parquet(f"{d}/part.parquet")
    from pyspark.sql import Window

    name = F.concat(F.lit("part_"), "p_partkey")
    w = Window.partitionBy("p_brand", "p_size").orderBy("p_partkey")
    body = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.coalesce(F.lag(name).over(w), F.lit("int")), F.lit("()"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("part_"), F.col("p_partkey") + 1, F.lit("()"))).otherwise(F.col("p_size").cast("string"))
    block = F.concat(F.lit("def "), name, F.lit("():\n    # "), "p_name", F.lit("\n    return "), body, F.lit("\n"))
    path = F.concat(F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "_"), F.lit("/size_"), "p_size", F.lit(".py"))
    x = p.select(path.alias("doc_id"), "p_partkey", block.alias("block"))
    return x.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "block"))), lambda b: b["block"]), "\n").alias("text"))


def outline_files(spark: SparkSession, d: str) -> DataFrame:
    """One outline, not Python, for each customer: a line for each order, its items below it, and a deeper line below each returned item."""
    order = F.concat(F.lit("order_"), "o_orderkey", F.lit(":"))
    item = F.concat(F.lit("  part_"), "l_partkey", F.lit(": "), F.col("l_quantity").cast("int"), F.when(F.col("l_returnflag") == "R", "\n    returned").otherwise(""))
    o = spark.read.parquet(f"{d}/orders.parquet")
    items = o.join(spark.read.parquet(f"{d}/lineitem.parquet"), F.col("o_orderkey") == F.col("l_orderkey"))
    x = o.select("o_custkey", "o_orderkey", F.lit(0).alias("n"), order.alias("text")).union(items.select("o_custkey", "o_orderkey", "l_linenumber", item))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "n", "text"))), lambda b: b["text"]), "\n")
    return x.groupBy("o_custkey").agg(text.alias("text")).select(F.concat(F.lit("customers/"), "o_custkey", F.lit(".yaml")).alias("doc_id"), "text")


def diff_texts(spark: SparkSession, d: str) -> DataFrame:
    """A diff that touches a few lines of every third code file and deletes every seventh; h is the least part of a file."""
    p = spark.read.parquet(f"{d}/part.parquet")
    path = F.concat(F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "_"), F.lit("/size_"), "p_size", F.lit(".py"))
    f = p.groupBy(path.alias("doc_id")).agg(F.min("p_partkey").alias("h"))
    hunk = F.concat(F.lit("--- a/"), "doc_id", F.lit("\n+++ b/"), "doc_id", F.lit("\n@@ -1,2 +"), (1 + F.col("h") % 9).cast("string"), F.lit(",2 @@\n context\n@@ -40 +"), (30 + F.col("h") % 20).cast("string"), F.lit(" @@\n+line\n"))
    gone = F.concat(F.lit("--- a/"), "doc_id", F.lit("\n+++ /dev/null\n@@ -1,3 +0,0 @@\n-line\n"))
    return f.filter("h % 3 = 0 OR h % 7 = 0").select(F.col("doc_id").alias("diff_id"), F.when(F.col("h") % 7 == 0, gone).otherwise(hunk).alias("text"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations with their first two turns repeated before everything else, so that old duplicates exist."""
    c = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", F.col("turn") + 100, "role", F.col("text").alias("content")).toDF("conv_id", "turn", "role", "content")
    w = hour_like("conv_id")
    again = c.withColumn("k", F.row_number().over(w)).filter("k <= 2").select("conv_id", F.col("k").alias("turn"), "role", "content")
    return again.unionByName(c).withColumn("turn", F.col("turn").cast("int"))


def hour_like(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy("turn")


TOKENS = r"""CAST(CASE WHEN length({t}) = 0 THEN 0 WHEN len(regexp_extract_all({t}, '\S+')) = 0 THEN greatest(1, round_even(length({t}) / {c}, 0))
  ELSE round_even((greatest(1, round_even(length({t}) / {c}, 0)) + greatest(1, round_even(len(regexp_extract_all({t}, '\S+')) * 1.3::DOUBLE, 0))) / 2, 0) END AS INTEGER)"""


def tokens_sql(text: str, chars: str = "4.0::DOUBLE") -> str:
    return TOKENS.replace("{t}", text).replace("{c}", chars)


def put(sql: str, **values: object) -> str:
    for name, value in ({"p": "", "docs": "documents"} | values).items():
        sql = sql.replace(f"@{name}@", str(value))
    return sql


SENTENCES = r"list_filter(string_split(regexp_replace(trim(text, E' \n\t\r'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(trim(s, E' \n\t\r')) > 0)"
SENTENCE_CHUNKS = f"chunks AS (SELECT doc_id, unnest(generate_series(0, len(s) - 1)) AS idx, unnest(s) AS text FROM (SELECT doc_id, {SENTENCES} AS s FROM documents) WHERE len(s) > 0)"
LINES = r"list_filter(string_split(text, chr(10)), lambda s: length(trim(s, E' \n\t\r')) > 0)"
CHUNKS_OF = f"chunks AS MATERIALIZED (SELECT doc_id, unnest(generate_series(0, len(s) - 1)) AS idx, unnest(s) AS text FROM (SELECT doc_id, CASE WHEN len({SENTENCES}) <= 1 AND len({LINES}) > 1 THEN {LINES} ELSE {SENTENCES} END AS s FROM @docs@) WHERE len(s) > 0)"
CHUNKS = put(CHUNKS_OF)
TERM = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_\-.]*[\p{L}\p{N}_])?"
VECTORS = f"""
  @p@sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM @chunks@),
  @p@tf AS (SELECT doc_id, idx, any_value(n) AS n, term, count(*) AS tf FROM (SELECT doc_id, idx, n, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM @p@sized) @stop@ GROUP BY doc_id, idx, term),
  @p@raw AS (SELECT *, count(*) OVER (PARTITION BY doc_id, term) AS df, tf * (ln((1 + n) / (1 + count(*) OVER (PARTITION BY doc_id, term))) + 1) AS r FROM @p@tf),
  @p@vectors AS MATERIALIZED (SELECT doc_id, idx, term, df, r / sqrt(sum(r * r) OVER (PARTITION BY doc_id, idx)) AS w FROM @p@raw)"""
PLAIN = "plain AS (SELECT * FROM chunks WHERE length(trim(text, E' \\n\\t\\r')) >= 3)"
DOTS_OF = "@p@dots AS (SELECT a.doc_id, a.idx AS i, b.idx AS j, round(sum(a.w * b.w), 9) AS similarity FROM @p@vectors a JOIN @p@vectors b ON a.doc_id = b.doc_id AND a.term = b.term AND a.idx < b.idx GROUP BY ALL)"
DOTS = put(DOTS_OF)
STOP = "WHERE term NOT IN (" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
FILLER = r"regexp_matches(text, '(?i)\A(?:\s*#[^\n]*$|\s*//[^\n]*$|\s*(import|from)\s+\S+|\s*(using|package)\s+\S+|\s*\{?\s*\}?\s*$|\s*(pass|continue|break)\s*$|\s*(INFO|DEBUG)\b[^\n]*heartbeat[^\n]*$)')"


@registered(f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents")
def token_count_default(spark, d):
    return documents(spark, d).select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@registered(f"SELECT doc_id, {tokens_sql('text', '3.8::DOUBLE')} AS tokens FROM documents")
def token_count_claude(spark, d):
    return documents(spark, d).select("doc_id", T.token_count(F.col("text"), "claude").alias("tokens"))


LOGS = r"""e AS (SELECT *, strftime(ts, '%Y-%m-%d %H') AS doc_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d %H') ORDER BY ts, event_id) - 1 AS n,
    concat_ws(' ', strftime(ts, '%Y-%m-%d %H:%M:%S'), CASE WHEN event_id % 10 = 0 THEN 'ERROR' WHEN event_id % 10 < 3 THEN 'WARN' ELSE 'INFO' END, event_type, 'value=' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)) AS head FROM events),
  lines AS (SELECT doc_id, CAST(n * 2 AS INTEGER) AS idx, head AS text FROM e UNION ALL SELECT doc_id, CAST(n * 2 + 1 AS INTEGER), '  at handler.' || event_type FROM e WHERE event_id % 10 = 0)"""
NORMAL = r"regexp_replace(trim(text, E' \n\t\r'), '\b\d[\d:,.\-T]*\d\b|\b\d+\b', '<N>', 'g')"


@registered(f"""WITH {LOGS}, texts AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents UNION ALL SELECT doc_id, string_agg(text, chr(10) ORDER BY idx) FROM lines GROUP BY doc_id),
  s AS (SELECT doc_id, len(regexp_extract_all(text, '(?m)^\\s*(?:def |class |import |function |const |let |var |#include)')) AS code, len(regexp_extract_all(text, '(?m)^\\s*\\[?\\d{{4}}-\\d{{2}}-\\d{{2}}|^\\s*(?:INFO|DEBUG|WARN|ERROR)\\b')) AS logs FROM texts)
  SELECT doc_id, CASE WHEN logs > code AND logs > 2 THEN 'logs' WHEN code > 2 THEN 'code' ELSE 'prose' END AS content_type FROM s""")
def content_type(spark, d):
    logs = chunking.joined_chunks(log_lines(spark, d), "\n")
    both = documents(spark, d).withColumn("doc_id", F.col("doc_id").cast("string")).unionByName(logs)
    return both.select("doc_id", T.content_type(F.col("text")).alias("content_type"))


@registered(f"WITH {SENTENCE_CHUNKS} SELECT doc_id, CAST(idx AS INTEGER) AS idx, text FROM chunks")
def sentence_chunks(spark, d):
    return chunking.sentence_chunks(documents(spark, d))


@registered("""SELECT page_id AS doc_id, CAST(unnest(generate_series(0, len(l) - 1)) AS INTEGER) AS idx, unnest(l) AS text
  FROM (SELECT page_id, CASE WHEN html LIKE '%' || chr(10) THEN list_slice(string_split(html, chr(10)), 1, -2) ELSE string_split(html, chr(10)) END AS l FROM pages WHERE length(html) > 0)""")
def line_chunks(spark, d):
    return chunking.line_chunks(spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))


@registered(f"WITH {LOGS} SELECT doc_id, idx, {NORMAL} AS line FROM lines")
def normalize_lines(spark, d):
    return log_lines(spark, d).select("doc_id", "idx", T.normalized_line(F.col("text")).alias("line"))


@registered(f"""WITH {LOGS}, k AS (SELECT *, {NORMAL} AS key FROM lines)
  SELECT doc_id, min(idx) AS idx, arg_min(text, idx) || CASE WHEN count(*) > 1 THEN '  [x' || count(*) || ' similar lines collapsed]' ELSE '' END AS text, count(*) AS n_similar FROM k GROUP BY doc_id, key""")
def collapse_similar_lines(spark, d):
    return structural.collapse_similar_lines(log_lines(spark, d))


BLANKED = "SELECT doc_id, idx, CASE WHEN idx % 7 < 3 THEN '  ' ELSE text END AS text FROM lines"


@registered(f"""WITH {LOGS}, b AS ({BLANKED}), x AS (SELECT *, trim(text) = '' AND coalesce(trim(lag(text) OVER (PARTITION BY doc_id ORDER BY idx)) = '', false) AS again FROM b)
  SELECT doc_id, idx, text FROM x WHERE NOT again""")
def collapse_blank_runs(spark, d):
    lines = log_lines(spark, d).withColumn("text", F.when(F.col("idx") % 7 < 3, "  ").otherwise(F.col("text")))
    return structural.collapse_blank_runs(lines)


SQUEEZED = f"""b AS ({BLANKED}), x AS (SELECT *, trim(text) = '' AS blank, trim(text) = '' AND coalesce(trim(lag(text) OVER (PARTITION BY doc_id ORDER BY idx)) = '', false) AS again FROM b),
  groups AS (SELECT doc_id, {NORMAL} AS key, count(*) AS n, min(idx) AS idx, arg_min(text, idx) AS text FROM x WHERE NOT blank GROUP BY ALL)"""


def blanked_lines(spark: SparkSession, d: str) -> DataFrame:
    return log_lines(spark, d).withColumn("text", F.when(F.col("idx") % 7 < 3, "  ").otherwise(F.col("text")))


@registered(f"WITH {LOGS}, {SQUEEZED} SELECT doc_id, CAST(coalesce(collapsed, 0) AS INTEGER) AS collapsed, CAST(blank_runs AS INTEGER) AS blank_runs FROM (SELECT doc_id, count_if(again) AS blank_runs FROM x GROUP BY doc_id) LEFT JOIN (SELECT doc_id, sum(n - 1) AS collapsed FROM groups GROUP BY doc_id) USING (doc_id)")
def structural_summary(spark, d):
    return structural.structural_pass(blanked_lines(spark, d), False)[1]


@registered(f"WITH {LOGS}, {SQUEEZED} SELECT doc_id, array_to_string(list_slice(list(n || 'x: ' || left(trim(text), 60) ORDER BY idx), 1, 10), chr(10)) AS notes FROM groups WHERE n > 1 GROUP BY doc_id")
def collapse_notes(spark, d):
    return structural.collapse_notes(blanked_lines(spark, d)).select("doc_id", F.array_join("notes", "\n").alias("notes"))


RECORDS = r"""r AS (SELECT *, CAST(sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS INTEGER) AS record_id FROM (
    SELECT *, trim(text) = '' OR regexp_matches(text, '^\s*(\[?\d{4}-\d{2}-\d{2}|(INFO|DEBUG|WARN|WARNING|ERROR|CRITICAL|Traceback)\b)') OR coalesce(trim(lag(text) OVER (PARTITION BY doc_id ORDER BY idx)) = '', true) AS begins FROM b))"""


@registered(f"WITH {LOGS}, b AS ({BLANKED}), {RECORDS} SELECT doc_id, idx, text, record_id FROM r")
def log_records(spark, d):
    return chunking.records(log_lines(spark, d).withColumn("text", F.when(F.col("idx") % 7 < 3, "  ").otherwise(F.col("text"))))


BY_LEVEL = "SELECT left(doc_id, 10) || CASE WHEN idx % 2 = 1 OR contains(text, ' ERROR ') THEN ' errors' ELSE ' others' END AS doc_id, CAST(CAST(right(doc_id, 2) AS INTEGER) * 67108864 + idx AS INTEGER) AS idx, text FROM lines"


@registered(f"""WITH {LOGS}, b AS ({BY_LEVEL}), {RECORDS}, k AS (SELECT doc_id, record_id, min(idx) AS idx, list({NORMAL} ORDER BY idx) AS key, list(text ORDER BY idx) AS body FROM r GROUP BY doc_id, record_id),
  i AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS island FROM (SELECT *, NOT coalesce(lag(key) OVER (PARTITION BY doc_id ORDER BY idx) = key AND len(key) >= 2, false) AS new FROM k)),
  n AS (SELECT doc_id, island, count(*) AS n, arg_min(body, idx) AS body, min(idx) AS idx, arg_min(body[1], idx) AS first, arg_max(body[1], idx) AS last FROM i GROUP BY doc_id, island)
  SELECT doc_id, idx, n - 1 AS n_blocks, body[2] || '  [repeated block x' || n || ', ' || left(first, 19) || ' .. ' || left(last, 19) || ']' AS text FROM (SELECT * REPLACE (CAST(idx + 1 AS INTEGER) AS idx) FROM n) WHERE n >= 3""")
def repeated_blocks(spark, d):
    # A day's errors, which have two lines each, are a log of their own, so that they follow each other; no line is left out.
    level = F.when((F.col("idx") % 2 == 1) | F.contains("text", F.lit(" ERROR ")), " errors").otherwise(" others")
    lines = log_lines(spark, d).select(F.concat(F.left("doc_id", F.lit(10)), level).alias("doc_id"), (F.right("doc_id", F.lit(2)).cast("int") * 67108864 + F.col("idx")).alias("idx"), "text")
    return structural.summarize_repeated_blocks(lines).filter("n_blocks > 0").select("doc_id", "idx", F.col("n_blocks").cast("long").alias("n_blocks"), "text")


@registered(f"WITH {CHUNKS}, {put(VECTORS, chunks='chunks', stop='')} SELECT doc_id, CAST(idx AS INTEGER) AS idx, term, df, round(w, 6) AS w FROM vectors")
def tfidf_vectors(spark, d):
    return similarity.term_rows(similarity.vectors(chunking.prose_chunks(documents(spark, d)))).select("doc_id", "idx", "term", "df", F.round("w", 6).alias("w"))


@registered(f"WITH {CHUNKS}, {PLAIN}, {put(VECTORS, chunks='plain', stop='')}, {DOTS} SELECT doc_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(similarity, 6) AS similarity FROM dots WHERE similarity >= 0.85")
def near_dup_pairs(spark, d):
    return similarity.similar_pairs(prose(spark, d), 0.85).select("doc_id", "i", "j", F.round("similarity", 6).alias("similarity"))


DROPS = """@p@adj AS (SELECT doc_id, j, list(i) AS nbrs FROM @p@dots WHERE similarity >= @t@ GROUP BY doc_id, j),
  @p@folded AS (SELECT doc_id, list_reduce(list({'j': j, 'nbrs': nbrs, 'd': CAST([] AS BIGINT[])} ORDER BY j), lambda a, x: {'j': x.j, 'nbrs': x.nbrs, 'd': CASE WHEN len(list_filter(x.nbrs, lambda n: NOT list_contains(a.d, n))) > 0 THEN list_append(a.d, x.j) ELSE a.d END},
    {'j': CAST(-1 AS BIGINT), 'nbrs': CAST([] AS BIGINT[]), 'd': CAST([] AS BIGINT[])}).d AS d FROM @p@adj GROUP BY doc_id),
  @p@drops AS MATERIALIZED (SELECT doc_id, unnest(d) AS idx FROM @p@folded)"""


@registered(f"WITH {CHUNKS}, {PLAIN}, {put(VECTORS, chunks='plain', stop='')}, {DOTS}, {put(DROPS, t=0.75)} SELECT doc_id, CAST(idx AS INTEGER) AS idx FROM drops")
def near_dup_drops(spark, d):
    return similarity.near_duplicates(prose(spark, d), 0.75)


@registered(f"""WITH {CHUNKS}, {PLAIN}, {put(VECTORS, chunks='plain', stop='')}, {DOTS}, n AS (SELECT doc_id, count(*) AS n FROM plain GROUP BY doc_id),
  s AS (SELECT doc_id, list(similarity) AS s FROM dots GROUP BY doc_id),
  q AS (SELECT n.doc_id, n, list_concat(coalesce(s, []), list_transform(generate_series(1, n * (n - 1) // 2 - coalesce(len(s), 0)), lambda z: 0.0::DOUBLE)) AS every FROM n LEFT JOIN s USING (doc_id))
  SELECT d.doc_id, round(CASE WHEN coalesce(n, 0) > 2 THEN least(greatest(list_aggregate(every, 'quantile_cont', 0.95), 0.6), 0.95) ELSE 0.6 END, 6) AS threshold FROM (SELECT DISTINCT doc_id FROM chunks) d LEFT JOIN q USING (doc_id)""")
def adaptive_threshold(spark, d):
    return similarity.adaptive_thresholds(prose(spark, d)).select("doc_id", F.round("threshold", 6).alias("threshold"))


SCORES = f"""{VECTORS.replace("@stop@", STOP)},
  mass AS (SELECT doc_id, idx, sum(w) AS mass FROM @p@vectors GROUP BY doc_id, idx),
  dense AS (SELECT *, max(density) OVER (PARTITION BY doc_id) AS top, count(*) OVER (PARTITION BY doc_id) AS n, count(mass) OVER (PARTITION BY doc_id) AS n_mass FROM
    (SELECT c.*, mass, coalesce(mass, 0) / sqrt(greatest(1, len(regexp_extract_all(text, '\\S+')))) AS density FROM @chunks@ c LEFT JOIN mass USING (doc_id, idx))),
  scored AS (SELECT doc_id, idx, text, CASE WHEN n = 1 OR n_mass = 0 THEN 1.0 WHEN length(trim(text, E' \\n\\t\\r')) < 3 THEN 0.0
    ELSE round(CASE WHEN top > 0 THEN density / top ELSE density END * CASE WHEN {FILLER} THEN 0.1 ELSE 1.0 END, 9) END AS score FROM dense)"""


@registered(f"WITH {CHUNKS}, {put(SCORES, chunks='chunks')} SELECT doc_id, CAST(idx AS INTEGER) AS idx, round(score, 6) AS score FROM scored")
def density_scores(spark, d):
    return similarity.density_scores(chunking.prose_chunks(documents(spark, d))).select("doc_id", "idx", F.round("score", 6).alias("score"))


SELECTED = f"""ranked AS (SELECT doc_id, score, idx, {tokens_sql('text')} AS tokens FROM scored),
  budgets AS MATERIALIZED (SELECT doc_id, text AS whole, {tokens_sql('text')} AS original_tokens, greatest(1, round_even({tokens_sql('text')} * (1.0::DOUBLE - @target@::DOUBLE), 0)) AS budget FROM @docs@),
  kept AS MATERIALIZED (SELECT doc_id, unnest(list_reduce(list({{'run': CAST(0 AS BIGINT), 'keep': CAST([] AS BIGINT[]), 'idx': CAST(idx AS BIGINT), 'tokens': CAST(tokens AS BIGINT), 'budget': budget}} ORDER BY score DESC, idx),
    lambda a, x: CASE WHEN a.run + x.tokens <= x.budget OR len(a.keep) = 0 THEN {{'run': a.run + x.tokens, 'keep': list_append(a.keep, x.idx), 'idx': x.idx, 'tokens': x.tokens, 'budget': x.budget}} ELSE a END,
    {{'run': CAST(0 AS BIGINT), 'keep': CAST([] AS BIGINT[]), 'idx': CAST(0 AS BIGINT), 'tokens': CAST(0 AS BIGINT), 'budget': CAST(0 AS DOUBLE)}}).keep) AS idx FROM ranked JOIN budgets USING (doc_id) GROUP BY doc_id)"""


@registered(f"WITH {CHUNKS}, {put(SCORES, chunks='chunks')}, {put(SELECTED, target=0.7)} SELECT doc_id, CAST(idx AS INTEGER) AS idx FROM kept")
def budget_select(spark, d):
    docs = documents(spark, d)
    chunks = chunking.prose_chunks(docs).withColumn("tokens", T.token_count(F.col("text")))
    scored = similarity.density_scores(chunks, with_text=False)
    return selection.select_under_budget(scored, docs.select("doc_id", T.budget(T.token_count(F.col("text")), 0.7).alias("budget"), F.lit(0).alias("spent")))


#: What ``compress`` does with prose, up to ``done`` (doc_id, original_tokens, after, n_total, n_kept, grown, body, whole), over @docs@ (doc_id, text).
PROSE = f"""{CHUNKS_OF}, {PLAIN}, {VECTORS.replace("@stop@", "").replace("@chunks@", "plain")}, {DOTS_OF}, {DROPS.replace("@t@", "0.85")},
  remaining AS MATERIALIZED (SELECT * FROM chunks ANTI JOIN drops USING (doc_id, idx)), {SCORES.replace("@p@", "r_").replace("@chunks@", "remaining")}, {SELECTED.replace("@target@", "0.7")},
  body AS (SELECT doc_id, string_agg(text, ' ' ORDER BY idx) AS body, count(*) AS n_kept FROM chunks JOIN kept USING (doc_id, idx) GROUP BY doc_id),
  counted AS (SELECT b.doc_id, original_tokens, whole, coalesce(body, '') AS body, coalesce(n_kept, 0) AS n_kept, coalesce(n_total, 0) AS n_total FROM budgets b LEFT JOIN body USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n_total FROM chunks GROUP BY doc_id) USING (doc_id)),
  done AS MATERIALIZED (SELECT *, after >= original_tokens AND n_total > 0 AS grown FROM (SELECT *, {tokens_sql('body')} AS after FROM counted))"""


@registered(f"""WITH {put(PROSE)} SELECT doc_id, original_tokens, CASE WHEN grown THEN original_tokens ELSE after END AS compressed_tokens, CAST(n_total AS INTEGER) AS chunks_total, CAST(CASE WHEN grown THEN n_total ELSE n_kept END AS INTEGER) AS chunks_kept,
  round(CASE WHEN original_tokens = 0 OR grown THEN 0.0 ELSE 1 - after / original_tokens END, 6) AS compression_ratio FROM done""")
def compress_prose(spark, d):
    return C.compress(documents(spark, d)).select("doc_id", "original_tokens", "compressed_tokens", F.round("compression_ratio", 6).alias("compression_ratio"), "chunks_total", "chunks_kept")


TOLD = f"""{PROSE}, near AS (SELECT doc_id, count(*) AS n_near FROM drops GROUP BY doc_id),
  told AS MATERIALIZED (SELECT d.*, CAST(CASE WHEN grown THEN original_tokens ELSE after END AS INTEGER) AS final, CASE WHEN grown THEN n_total ELSE n_kept END AS n_stay, coalesce(n_near, 0) AS n_near, CASE WHEN original_tokens = 0 THEN [] ELSE
    ['detected content type: prose', 'structural pass: skipped (prose content)'] || CASE WHEN n_total > 0 THEN ['semantic dedup: removed ' || coalesce(n_near, 0) || ' near-duplicate chunks'] ELSE [] END
    || CASE WHEN grown THEN ['guardrail: compression would have increased size, returned original text'] ELSE [] END END AS notes FROM done d LEFT JOIN near USING (doc_id)),
  headed AS (SELECT *, original_tokens || ' -> ' || final || ' tokens (' || format('{{:.1f}}', CASE WHEN original_tokens = 0 THEN 0.0 ELSE (1 - final / original_tokens) * 100 END) || '% reduction), ' || n_stay || '/' || n_total || ' chunks kept, ' || n_near || ' near-duplicates removed, 0 repeated lines collapsed' AS summary FROM told),
  flagged AS (SELECT c.doc_id, c.idx, c.text, k.idx IS NOT NULL OR grown AS stays FROM chunks c JOIN done USING (doc_id) LEFT JOIN kept k ON k.doc_id = c.doc_id AND k.idx = c.idx)"""
ESCAPE = "replace(replace(replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"


@registered(f"WITH {put(TOLD)} SELECT doc_id, CAST(unnest(generate_series(1, len(notes))) AS INTEGER) AS step, unnest(notes) AS note FROM told")
def compress_notes(spark, d):
    return C.compress(documents(spark, d)).select("doc_id", F.posexplode("notes").alias("step", "note")).withColumn("step", F.col("step") + 1)


def report_of(compressed: DataFrame, layout: Callable) -> DataFrame:
    """(doc_id, report): a report for each compressed text."""
    line = reports.summary(*map(F.col, ("original_tokens", "compressed_tokens", "compression_ratio", "chunks_kept", "chunks_total", "near_duplicates_removed", "structural_lines_collapsed")))
    return compressed.select("doc_id", layout(F.concat(F.lit("Document "), F.col("doc_id").cast("string")), line, F.col("notes"), F.col("diff_lines")).alias("report"))


@registered(f"""WITH {put(TOLD)}, marked AS (SELECT doc_id, list(CASE WHEN stays THEN '+ ' ELSE '- ' END || replace(text, chr(10), chr(10) || CASE WHEN stays THEN '+ ' ELSE '- ' END) ORDER BY idx) AS rows FROM flagged GROUP BY doc_id)
  SELECT doc_id, array_to_string(['# Document ' || doc_id, '', '**' || summary || '**', '', '## Notes', ''] || list_transform(notes, lambda n: '- ' || n) || ['', '## Diff', '', '`+` kept · `-` dropped', '', '```diff'] || coalesce(rows, []) || ['```', ''], chr(10)) AS report FROM headed LEFT JOIN marked USING (doc_id)""")
def report_markdown(spark, d):
    return report_of(C.compress(documents(spark, d)), reports.markdown)


@registered(f"""WITH {put(TOLD)}, lines AS (SELECT doc_id, idx, stays, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM flagged),
  marked AS (SELECT doc_id, string_agg('<span class="' || CASE WHEN stays THEN 'kept' ELSE 'dropped' END || '">' || CASE WHEN line = '' THEN '&nbsp;' ELSE {ESCAPE.replace("{t}", "line")} END || '</span>', '' ORDER BY idx, k) AS rows FROM lines GROUP BY doc_id)
  SELECT doc_id, '<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="utf-8"><title>Document ' || doc_id || '</title>' || chr(10) || '<style>{reports.STYLE}</style>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || '<h1>Document ' || doc_id || '</h1>' || chr(10)
    || '<div class="summary">' || {ESCAPE.replace("{t}", "summary")} || '</div>' || chr(10) || '<h2>Notes</h2>' || chr(10) || '<ul class="notes">' || array_to_string(list_transform(notes, lambda n: '<li>' || n || '</li>'), '') || '</ul>' || chr(10)
    || '<h2>Diff</h2>' || chr(10) || '<div class="diff">' || coalesce(rows, '') || '</div>' || chr(10) || '</body>' || chr(10) || '</html>' || chr(10) AS report FROM headed LEFT JOIN marked USING (doc_id)""")
def report_html(spark, d):
    return report_of(C.compress(documents(spark, d)), reports.html)


@registered(f"""WITH {put(TOLD)}, by_source AS (SELECT source, sum(original_tokens) AS before, sum(final) AS after FROM told JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY source),
  results AS (SELECT 'compress' AS adapter, source, before, after, NULL::DOUBLE AS retention FROM by_source UNION ALL SELECT 'whole', source, before, before, 1.0 FROM by_source)
  SELECT adapter, NULL::VARCHAR AS skipped_reason, count(*) AS datasets_evaluated, round(1 - sum(after) / sum(before), 6) AS overall_compression_ratio, avg(retention) AS avg_retention FROM results GROUP BY adapter
  UNION ALL SELECT 'judge', 'no judge configured', 0, NULL, NULL FROM documents HAVING count(*) > 0""")
def leaderboard(spark, d):
    """Compression against whole texts, a dataset for each source; a third adapter is skipped everywhere."""
    source = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source")
    sums = C.compress(documents(spark, d)).join(source, "doc_id").groupBy("source").agg(F.sum("original_tokens").alias("before"), F.sum("compressed_tokens").alias("after"))
    result = lambda name, after, retention, reason: F.struct(F.lit(name).alias("adapter"), after.alias("compressed_tokens"), retention.cast("double").alias("retention"), reason.cast("string").alias("skipped_reason"))
    three = F.array(result("compress", F.col("after"), F.lit(None), F.lit(None)), result("whole", F.col("before"), F.lit(1.0), F.lit(None)), result("judge", F.lit(0).cast("long"), F.lit(None), F.lit("no judge configured")))
    results = sums.select(F.col("source").alias("dataset"), F.col("source").alias("seq"), F.col("before").alias("original_tokens"), F.inline(three))
    return board.leaderboard(results).withColumn("overall_compression_ratio", F.round("overall_compression_ratio", 6))


MODELS = " UNION ALL ".join(f"SELECT '{m}' AS model, {CONTEXT_WINDOWS[m]} AS win, {PRICES[m]}::DOUBLE AS price" for m in PRICES)


@registered(f"""WITH m AS ({MODELS}), t AS (SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents)
  SELECT doc_id, model, tokens, CAST(least(999, floor(tokens / win * 100 + 0.5)) AS INTEGER) AS percent, CAST(greatest(0, floor(tokens * (1.0::DOUBLE - 0.7::DOUBLE) + 0.5)) AS INTEGER) AS estimated, round(tokens / 1000000 * price, 9) AS cost FROM t, m""")
def model_fit(spark, d):
    """Each document against each of six models: the share of the window, the tokens after compression, the price."""
    t = documents(spark, d).select("doc_id", T.token_count(F.col("text")).alias("tokens"))
    models = F.array(*(F.struct(F.lit(m).alias("model"), F.lit(CONTEXT_WINDOWS[m]).alias("win"), F.lit(PRICES[m]).alias("price")) for m in PRICES))
    return t.select("doc_id", "tokens", F.inline(models)).select(
        "doc_id", "model", "tokens", T.budget_percent(F.col("tokens"), F.col("win")).alias("percent"), T.estimated_tokens(F.col("tokens"), 0.7).alias("estimated"), F.round(T.cost(F.col("tokens"), F.col("price")), 9).alias("cost"),
    )


@registered("""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN doc_id % 8 = 3 ELSE doc_id % 4 = 0 END AS agrees, CASE doc_id % 4 WHEN 3 THEN 'judge response was not valid JSON; fell back to keyword match' WHEN 2 THEN '' ELSE 'source ' || source END AS reason FROM documents""")
def judge_replies(spark, d):
    """Replies of a judge for each document, as JSON with and without a reason and as plain text, and parsed."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kind = F.col("doc_id") % 4
    reason = F.concat(F.lit("source "), "source")
    plain = F.when(F.col("doc_id") % 8 == 3, "TRUE, both say so").otherwise("They do not, it is not true")
    raw = F.when(kind == 0, F.to_json(F.struct(F.lit(True).alias("agrees"), reason.alias("reason")))).when(kind == 1, F.to_json(F.struct(F.lit(False).alias("agrees"), reason.alias("reason")))).when(kind == 2, F.lit('{"agrees": null}')).otherwise(plain)
    return docs.select("doc_id", T.judgement(raw).alias("j")).select("doc_id", "j.agrees", "j.reason")


@registered()
def compress_logs(spark, d):
    return C.compress(chunking.joined_chunks(log_lines(spark, d), "\n")).drop("diff_lines")


@registered()
def compress_code(spark, d):
    return C.compress(code_files(spark, d), content_type="code").drop("diff_lines")


BLOCKS = r"""q AS (SELECT *, regexp_replace(lower(p_brand), '[^a-z0-9]', '_', 'g') || '/size_' || p_size || '.py' AS path, lag(p_partkey) OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS before FROM part),
  blocks AS MATERIALIZED (SELECT path, p_partkey AS k, CAST(row_number() OVER (PARTITION BY path ORDER BY p_partkey) - 1 AS INTEGER) AS idx, 'def part_' || p_partkey || '():' || chr(10) || '    # ' || p_name || chr(10) || '    return ' ||
    CASE p_partkey % 3 WHEN 0 THEN coalesce('part_' || before, 'int') || '()' WHEN 1 THEN 'part_' || (p_partkey + 1) || '()' ELSE CAST(p_size AS VARCHAR) END AS text FROM q),
  placed AS (SELECT *, CAST(1 + 4 * idx AS INTEGER) AS start_line, CAST(3 + 4 * idx AS INTEGER) AS end_line FROM blocks)"""
HUNKS = """f AS (SELECT path, min(k) AS h FROM blocks GROUP BY path), hunks AS (SELECT path AS diff_id, path, CAST(1 + h % 9 AS INTEGER) AS new_start, 2 AS new_lines, CAST(2 + h % 9 AS INTEGER) AS new_end FROM f WHERE h % 3 = 0 AND h % 7 <> 0
  UNION ALL SELECT path, path, CAST(30 + h % 20 AS INTEGER), 1, CAST(30 + h % 20 AS INTEGER) FROM f WHERE h % 3 = 0 AND h % 7 <> 0)"""


@registered(f"WITH {BLOCKS} SELECT path AS doc_id, idx, text, start_line, end_line, 'part_' || k AS defines, 'ast' AS strategy FROM placed")
def code_blocks(spark, d):
    return chunking.code_blocks(code_files(spark, d), True).select("doc_id", "idx", "text", "start_line", "end_line", F.array_join("defines", ",").alias("defines"), "strategy")


# An order's line begins a block if an item's line is right before it: orders without items go on in one block.
@registered("""WITH entries AS (SELECT o_custkey AS c, o_orderkey AS o, 0 AS n, 'order_' || o_orderkey || ':' AS text FROM orders
    UNION ALL SELECT o_custkey, o_orderkey, l_linenumber, '  part_' || l_partkey || ': ' || CAST(floor(l_quantity) AS INTEGER) || CASE WHEN l_returnflag = 'R' THEN chr(10) || '    returned' ELSE '' END FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
  placed AS (SELECT *, len(string_split(text, chr(10))) AS height, sum(len(string_split(text, chr(10)))) OVER w AS last, row_number() OVER w AS i, lag(n) OVER w AS before FROM entries WINDOW w AS (PARTITION BY c ORDER BY o, n, text ROWS UNBOUNDED PRECEDING)),
  dealt AS (SELECT *, sum(CASE WHEN n = 0 AND before > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY i) AS idx FROM placed)
  SELECT 'customers/' || c || '.yaml' AS doc_id, CAST(idx AS INTEGER) AS idx, string_agg(text, chr(10) ORDER BY i) AS text, CAST(min(last - height + 1) AS INTEGER) AS start_line, CAST(max(last) AS INTEGER) AS end_line, 'indentation' AS strategy FROM dealt GROUP BY c, idx""")
def indentation_blocks(spark, d):
    return chunking.code_blocks(outline_files(spark, d), True).select("doc_id", "idx", "text", "start_line", "end_line", "strategy")


@registered("""SELECT 'part_' || p_partkey AS name, regexp_replace(lower(p_brand), '[^a-z0-9]', '_', 'g') || '/size_' || p_size || '.py' AS path FROM part""")
def symbol_table(spark, d):
    return graph.symbol_table(chunking.code_blocks(code_files(spark, d), True), None).select("name", F.col("doc_id").alias("path"))


EDGES = """p AS (SELECT p_partkey AS k, regexp_replace(lower(p_brand), '[^a-z0-9]', '_', 'g') || '/size_' || p_size || '.py' AS path, lag(p_partkey) OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS prev FROM part),
  edges AS (SELECT k AS a, CASE WHEN k % 3 = 0 THEN prev WHEN k % 3 = 1 THEN k + 1 END AS b FROM p), known AS (SELECT a, b FROM edges SEMI JOIN p ON b = k WHERE b IS NOT NULL)"""


@registered(f"WITH RECURSIVE {EDGES}, r AS (SELECT k AS a FROM p WHERE k % 10 = 0 UNION SELECT b FROM r JOIN known USING (a)) SELECT 'part_' || a AS name FROM r")
def dependency_closure(spark, d):
    # Files are parsed once and references looked up once, however many rounds follow.
    blocks = written(chunking.code_blocks(code_files(spark, d), True), "blocks")
    kept = blocks.select("doc_id", "idx", F.explode("defines").alias("name")).filter(F.regexp_extract("name", r"(\d+)$", 1).cast("long") % 10 == 0).select("doc_id", "idx")
    reached = graph.dependency_closure(kept, written(graph.reference_edges(blocks, graph.symbol_table(blocks, None), None), "edges"))
    return reached.join(blocks, ["doc_id", "idx"]).select(F.explode("defines").alias("name"))


@registered(f"WITH {BLOCKS}, {HUNKS} SELECT * FROM hunks")
def diff_hunks(spark, d):
    return diffs.parse_hunks(diff_texts(spark, d))


@registered(f"WITH {BLOCKS}, {HUNKS} SELECT DISTINCT b.path AS doc_id, idx, start_line, end_line FROM placed b JOIN hunks h ON b.path = h.path AND start_line <= new_end AND new_start <= end_line")
def touched_blocks(spark, d):
    return diffs.touched_blocks(chunking.code_blocks(code_files(spark, d), True), diffs.parse_hunks(diff_texts(spark, d))).select("doc_id", "idx", "start_line", "end_line")


DIFF = f"""{BLOCKS}, {HUNKS}, touched AS MATERIALIZED (SELECT DISTINCT b.path, idx, k, text FROM placed b JOIN hunks h ON b.path = h.path AND start_line <= new_end AND new_start <= end_line),
  own AS MATERIALIZED (SELECT * FROM blocks SEMI JOIN hunks USING (path)), chunks AS MATERIALIZED (SELECT path AS doc_id, idx, text FROM own ANTI JOIN touched USING (k)),
  texts AS (SELECT path AS doc_id, string_agg(text || chr(10), chr(10) ORDER BY idx) AS text FROM own GROUP BY path), spent AS (SELECT path AS doc_id, sum({tokens_sql("text")}) AS spent FROM touched GROUP BY path),
  {put(SCORES, chunks="chunks")}, {put(SELECTED, docs="texts", target=0.7).replace(" OR len(a.keep) = 0", "").replace("JOIN budgets USING", "JOIN (SELECT doc_id, budget - coalesce(spent, 0) AS budget FROM budgets LEFT JOIN spent USING (doc_id)) USING")},
  edges AS (SELECT k AS a, CASE WHEN k % 3 = 0 THEN prior WHEN k % 3 = 1 THEN k + 1 END AS b, path FROM (SELECT k, path, lag(k) OVER (PARTITION BY path ORDER BY k) AS prior FROM own)), known AS (SELECT a, b FROM edges e SEMI JOIN own o ON e.b = o.k AND e.path = o.path),
  chosen AS MATERIALIZED (SELECT k FROM own b JOIN kept s ON b.path = s.doc_id AND b.idx = s.idx UNION SELECT k FROM touched), reached AS (SELECT k FROM chosen UNION SELECT b FROM reached JOIN known ON a = k),
  files AS (SELECT b.path, string_agg(b.text, chr(10) || chr(10) ORDER BY b.idx) FILTER (r.k IS NOT NULL) AS body, count(*) AS n, count(r.k) AS n_kept, count(t.k) AS n_changed, count(r.k) - count(c.k) AS n_restored
    FROM own b LEFT JOIN reached r ON r.k = b.k LEFT JOIN chosen c ON c.k = b.k LEFT JOIN touched t ON t.k = b.k GROUP BY b.path)"""


@registered(f"""WITH RECURSIVE {DIFF} SELECT path AS diff_id, path, original_tokens, CAST(least(after, original_tokens) AS INTEGER) AS compressed_tokens, CASE WHEN after >= original_tokens THEN whole ELSE coalesce(body, '') END AS compressed_text, CAST(n_changed AS INTEGER) AS changed_blocks_kept,
  CAST(CASE WHEN after >= original_tokens THEN n ELSE n_kept END - n_changed - n_restored AS INTEGER) AS context_blocks_kept, CAST(n_restored AS INTEGER) AS dependency_blocks_restored, CAST(n AS INTEGER) AS blocks_total
  FROM (SELECT *, {tokens_sql("coalesce(body, '')")} AS after FROM files) JOIN budgets ON doc_id = path""")
def compress_diff(spark, d):
    return C.compress_diff(diffs.parse_hunks(diff_texts(spark, d)), code_files(spark, d)).drop("diff_lines")


REPO = f"""{BLOCKS}, chunks AS MATERIALIZED (SELECT path AS doc_id, idx, text FROM blocks), texts AS (SELECT path AS doc_id, string_agg(text || chr(10), chr(10) ORDER BY idx) AS text FROM blocks GROUP BY path),
  {put(SCORES, chunks="chunks")}, {put(SELECTED, docs="texts", target=0.7)},
  edges AS (SELECT k AS a, CASE WHEN k % 3 = 0 THEN prior WHEN k % 3 = 1 THEN k + 1 END AS b FROM (SELECT k, lag(k) OVER (PARTITION BY path ORDER BY k) AS prior FROM blocks)), known AS (SELECT a, b FROM edges SEMI JOIN blocks ON b = k),
  chosen AS (SELECT k FROM blocks b JOIN kept s ON b.path = s.doc_id AND b.idx = s.idx), reached AS (SELECT k FROM chosen UNION SELECT b FROM reached JOIN known ON a = k),
  files AS (SELECT path, string_agg(text, chr(10) || chr(10) ORDER BY idx) FILTER (r.k IS NOT NULL) AS body, count(*) AS n, count(r.k) AS n_kept, count(r.k) - count(c.k) AS n_restored FROM blocks b LEFT JOIN reached r ON r.k = b.k LEFT JOIN chosen c ON c.k = b.k GROUP BY path),
  repo AS (SELECT path, original_tokens, CAST(least(after, original_tokens) AS INTEGER) AS compressed_tokens, CASE WHEN after >= original_tokens THEN whole ELSE body END AS compressed_text, 0 AS changed_blocks_kept, CAST(n_kept - n_restored AS INTEGER) AS context_blocks_kept,
    CAST(n_restored AS INTEGER) AS dependency_blocks_restored, CAST(n AS INTEGER) AS blocks_total FROM (SELECT *, {tokens_sql("coalesce(body, '')")} AS after FROM files) JOIN budgets ON doc_id = path)"""


@registered(f"WITH RECURSIVE {REPO} SELECT * FROM repo")
def compress_repo(spark, d):
    return C.compress_repo(code_files(spark, d)).drop("diff_lines")


@registered(f"""WITH RECURSIVE {REPO} SELECT *, CASE WHEN original_tokens > 0 THEN 1 - compressed_tokens / original_tokens ELSE 0.0 END AS compression_ratio FROM (SELECT count(*) AS files, CAST(sum(original_tokens) AS BIGINT) AS original_tokens,
  CAST(sum(compressed_tokens) AS BIGINT) AS compressed_tokens, CAST(sum(dependency_blocks_restored) AS BIGINT) AS restored FROM repo)""")
def repo_totals(spark, d):
    return C.totals(C.compress_repo(code_files(spark, d)))


TURNS = """c AS (SELECT conv_id, turn + 100 AS turn, role, text AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
  turns AS (SELECT conv_id, k AS turn, role, content FROM c WHERE k <= 2 UNION ALL SELECT conv_id, turn, role, content FROM c)"""


@registered(f"""WITH {TURNS}, x AS (SELECT *, role = 'system' AS sys, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS back FROM turns)
  SELECT conv_id, CAST(turn AS INTEGER) AS turn, CASE WHEN sys THEN 'protected_system' WHEN back <= 4 THEN 'protected_recent' ELSE 'open' END AS protection FROM x""")
def protected_turns(spark, d):
    acted = sessions.turn_actions(turns(spark, d), dedup_threshold=2.0)
    return acted.select("conv_id", "turn", F.when(F.col("action") == "compressed", "open").otherwise(F.col("action")).alias("protection"))


ACTIONS = f"""marked AS MATERIALIZED (SELECT *, NOT sys AND back <= 4 AS recent, {tokens_sql('content')} AS tokens FROM (SELECT *, role = 'system' AS sys, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS back FROM turns)),
  t_plain AS (SELECT * FROM (SELECT conv_id || '/' || role AS doc_id, turn AS idx, content AS text FROM marked WHERE NOT sys AND NOT recent) WHERE length(trim(text, E' \\n\\t\\r')) >= 3),
  {put(VECTORS, p="t_", chunks="t_plain", stop="")}, {put(DOTS_OF, p="t_")}, {put(DROPS, p="t_", t=0.9)},
  actions AS MATERIALIZED (SELECT m.*, CASE WHEN sys THEN 'protected_system' WHEN d.idx IS NOT NULL AND NOT recent THEN 'dropped_duplicate' WHEN recent THEN 'protected_recent' ELSE 'compressed' END AS action
    FROM marked m LEFT JOIN t_drops d ON d.doc_id = m.conv_id || '/' || m.role AND d.idx = m.turn)"""
SESSION = f"""{ACTIONS}, olds AS (SELECT conv_id || '/' || turn AS doc_id, content AS text FROM actions WHERE action = 'compressed' AND tokens >= 20), {put(PROSE, docs="olds")},
  session AS (SELECT conv_id, CAST(turn AS INTEGER) AS turn, role, action, tokens AS original_tokens, CAST(CASE WHEN action = 'dropped_duplicate' THEN 0 WHEN d.doc_id IS NULL THEN tokens WHEN grown THEN d.original_tokens ELSE after END AS INTEGER) AS compressed_tokens,
    CASE WHEN action = 'dropped_duplicate' THEN '' WHEN d.doc_id IS NULL THEN content WHEN grown THEN whole ELSE body END AS content FROM actions a LEFT JOIN done d ON d.doc_id = a.conv_id || '/' || a.turn)"""


@registered(f"WITH {TURNS}, {ACTIONS} SELECT conv_id, CAST(turn AS INTEGER) AS turn, role, action, tokens FROM actions")
def turn_actions(spark, d):
    return sessions.turn_actions(turns(spark, d)).select("conv_id", "turn", "role", "action", "tokens")


@registered(f"WITH {TURNS}, {SESSION} SELECT * FROM session")
def compress_session(spark, d):
    return C.compress_session(turns(spark, d))


@registered(f"WITH RECURSIVE {REPO.replace('SEMI JOIN blocks ON b = k)', 'WHERE EXISTS (SELECT 1 FROM blocks x, blocks y WHERE x.k = a AND y.k = b AND split_part(x.path, chr(47), 1) = split_part(y.path, chr(47), 1)))')} SELECT split_part(path, '/', 1) AS repo, * FROM repo")
def compress_repos(spark, d):
    """Each brand's files are a repository of their own: references lead nowhere else."""
    return C.compress_repo(code_files(spark, d).withColumn("repo", F.split("doc_id", "/")[0])).drop("diff_lines")


@registered(f"""WITH {TURNS}, {SESSION} SELECT *, greatest(0.0, CASE WHEN original_tokens > 0 THEN 1 - compressed_tokens / original_tokens ELSE 0.0 END) AS compression_ratio FROM (SELECT conv_id, count(*) AS turns_total, CAST(count_if(action <> 'dropped_duplicate') AS BIGINT) AS turns_kept,
  CAST(count_if(action = 'dropped_duplicate') AS BIGINT) AS turns_dropped_duplicate, CAST(sum(original_tokens) AS BIGINT) AS original_tokens, CAST(sum(compressed_tokens) AS BIGINT) AS compressed_tokens FROM session GROUP BY conv_id)""")
def session_totals(spark, d):
    return C.session_totals(C.compress_session(turns(spark, d)))


PARSED = """SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'generic' WHEN 1 THEN 'claude' ELSE 'chatgpt' END AS format, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn,
  CASE WHEN conv_id % 3 = 1 AND role NOT IN ('assistant', 'system') THEN 'user' ELSE role END AS role, text AS content FROM conversations"""


@registered(PARSED)
def parse_exports(spark, d):
    """Conversations written as exports in three formats, and parsed."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    listed = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    generic = F.to_json(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))))
    claude = F.to_json(F.struct(F.transform("t", lambda x: F.struct(F.when(x["role"] == "user", "human").otherwise(x["role"]).alias("sender"), x["text"].alias("text"))).alias("chat_messages")))
    node = lambda x, i: F.struct(F.concat(F.lit("n"), i.cast("string")).alias("key"), F.struct(F.when(i > 0, F.concat(F.lit("n"), (i - 1).cast("string"))).alias("parent"), F.struct(F.struct(x["role"].alias("role")).alias("author"), F.struct(F.array(x["text"]).alias("parts")).alias("content")).alias("message")).alias("value"))
    tree = F.to_json(F.struct(F.concat(F.lit("n"), (F.size("t") - 1).cast("string")).alias("current_node"), F.map_from_entries(F.transform("t", node)).alias("mapping")))
    raw = F.when(F.col("conv_id") % 3 == 0, generic).when(F.col("conv_id") % 3 == 1, claude).otherwise(tree)
    parsed = sessions.parse_exports(listed.select("conv_id", raw.alias("raw")))
    return parsed.select("conv_id", "format", F.posexplode("turns").alias("turn", "t")).select("conv_id", "format", "turn", "t.role", "t.content")


@registered("""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn, role, CASE (conv_id + turn) % 6 WHEN 1 THEN '["' || role || '"]' WHEN 2 THEN text || chr(10) || role
  WHEN 4 THEN '[tool_use: ' || role || ']' || chr(10) || text WHEN 5 THEN '{"text": 1}' ELSE text END AS content FROM conversations WHERE length(text) > 0""")
def export_contents(spark, d):
    """Messages whose content is a string, a string that looks like JSON, a mixed list, an object, blocks of tools, and a string that looks like an object."""
    c = spark.read.parquet(f"{d}/conversations.parquet").filter(F.length("text") > 0)
    quoted = lambda x: F.expr(f"substring(to_json(array({x})), 2, length(to_json(array({x}))) - 2)")
    text, role = quoted("text"), quoted("role")
    shapes = [
        text, F.concat(F.lit('"[\\"'), "role", F.lit('\\"]"')), F.concat(F.lit("["), text, F.lit(', "", {"type": "text", "text": '), role, F.lit("}]")), F.concat(F.lit('{"type": "text", "text": '), text, F.lit("}")),
        F.concat(F.lit('[{"type": "tool_use", "name": '), role, F.lit('}, {"type": "image"}, {"type": "text", "text": '), text, F.lit("}]")), F.lit('"{\\"text\\": 1}"'),
    ]
    content = functools.reduce(lambda a, k: a.when((F.col("conv_id") + F.col("turn")) % 6 == k, shapes[k]), range(1, 6), F.when((F.col("conv_id") + F.col("turn")) % 6 == 0, shapes[0]))
    message = F.concat(F.lit('{"role": '), role, F.lit(', "content": '), content, F.lit("}"))
    listed = c.select("conv_id", "turn", message.alias("m")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "m"))).alias("t"))
    raw = F.concat(F.lit("["), F.array_join(F.transform("t", lambda x: x["m"]), ","), F.lit("]"))
    return sessions.exploded_turns(sessions.parse_exports(listed.select("conv_id", raw.alias("raw"))))


@registered("SELECT preset, CAST(count(*) AS BIGINT) AS docs, CAST(sum(budget) AS BIGINT) AS budget FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS preset, greatest(1, round_even({tokens_sql('text')} * (1.0::DOUBLE - {v[0]}::DOUBLE), 0)) AS budget FROM documents" for n, v in PRESETS.items()) + ") GROUP BY preset")
def preset_matrix(spark, d):
    counted = documents(spark, d).select(T.token_count(F.col("text")).alias("tokens"))
    # Three rows of presets for each document, without a join.
    presets = F.array(*(F.struct(F.lit(n).alias("preset"), F.lit(v[0]).alias("target")) for n, v in PRESETS.items()))
    return counted.select("tokens", F.inline(presets)).groupBy("preset").agg(F.count(F.lit(1)).alias("docs"), F.sum(T.budget(F.col("tokens"), F.col("target"))).cast("long").alias("budget"))


@registered(f"SELECT source, CAST(sum(t) AS BIGINT) AS tokens, round(sum(t) / 1e6 * 3.0, 6) AS cost, round(sum(t) * 0.7 / 1e6 * 3.0, 6) AS saved FROM (SELECT source, {tokens_sql('text')} AS t FROM documents) GROUP BY source")
def cost_savings(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("source", T.token_count(F.col("text")).alias("t"))
    return t.groupBy("source").agg(F.sum("t").alias("tokens"), F.round(T.cost(F.sum("t"), F.lit(PRICES["default"])), 6).alias("cost"), F.round(T.cost(F.sum("t") * 0.7, F.lit(PRICES["default"])), 6).alias("saved"))


@registered(f"SELECT doc_id, round(least(greatest(1 - 500 / t, 0.05), 0.95), 6) AS target FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents) WHERE t > 0")
def budget_fit(spark, d):
    t = documents(spark, d).select("doc_id", T.token_count(F.col("text")).alias("t")).filter("t > 0")
    return t.select("doc_id", F.round(T.fit_target(F.col("t"), F.lit(500)), 6).alias("target"))


@registered("SELECT toxic AS adapter, CAST(count(*) AS BIGINT) AS n, round(avg(quality), 6) AS retention FROM labels GROUP BY toxic")
def retention(spark, d):
    return spark.read.parquet(f"{d}/labels.parquet").groupBy(F.col("toxic").alias("adapter")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("retention"))


@registered(f"""WITH {LOGS} SELECT strptime(doc_id, '%Y-%m-%d %H') AS hour, {NORMAL} AS line, count(*) AS n_similar FROM lines GROUP BY ALL""")
def stream_collapse(spark, d):
    lines = log_lines(spark, d).select(F.to_timestamp("doc_id", "yyyy-MM-dd HH").alias("ts"), "text")
    return collapse_stream(lines).select(F.col("window.start").alias("hour"), "line", "n_similar")
