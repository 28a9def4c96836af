"""Line deduplication by overlapping three-line windows.

A text's lines that hold a word are hashed in windows of three consecutive
ones. A window found more than once in the corpus keeps its first occurrence,
by (doc_id, place); all lines that later occurrences cover are removed.

Only DataFrame functions are used. Windows are counted with a partial
aggregation, so one that fills a third of the corpus reaches its reducer as
one row per map task; only windows that repeat go on to the join. Both sides of
it are tables, so adaptive execution can split a hot window. Nothing gathers the
occurrences of a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table, text_key, written

WINDOW = 3


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def windows(docs: DataFrame) -> DataFrame:
    """One row per window of each text: its 128-bit hash (h1, h2), doc_id, row_key and the places of its lines among all lines of the text."""
    lines = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))

    def each(s: Column) -> Column:
        three = lambda i: [F.get(s, i + k)["x"] for k in range(WINDOW)]
        made = lambda i: F.struct(F.xxhash64(*three(i)).alias("h1"), F.xxhash64(F.lit("other seed"), *three(i)).alias("h2"), F.array(*(F.get(s, i + k)["i"] for k in range(WINDOW))).alias("at"))
        return F.when(F.size(s) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(s) - WINDOW), made))

    spans = let(F.filter(lines, lambda s: _has_word(s["x"])), each)
    return docs.select("doc_id", text_key(F.col("text")).alias("row_key"), F.explode(spans).alias("w")).select("w.h1", "w.h2", "doc_id", "row_key", "w.at")


def removed_lines(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` that loses lines: doc_id, row_key and the sorted places of the lost lines."""
    found = written(windows(docs))
    place = F.struct("doc_id", "row_key", F.get("at", F.lit(0)).alias("i"))
    again = written(found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last"))
    later = found.join(again, ["h1", "h2"]).where(place != F.col("first"))
    return later.groupBy("doc_id", "row_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("lost"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """Every row of ``docs``, with all its columns, its text without the repeated lines, and ``_lines`` and ``_removed``: how many lines it had and lost.

    A text with fewer than three lines that hold a word has no window and
    stays as it is, and so do null and empty texts. Lines without a word are
    in no window and stay. Rows that share both doc_id and text are taken as
    one document: they get the same result. A null doc_id sorts first. An
    empty table gives an empty result.
    """
    lost = removed_lines(docs).select(F.col("doc_id").alias("_d_id"), F.col("row_key").alias("_d_key"), F.col("lost").alias("_d_lost"))
    joined = docs.join(lost, docs["doc_id"].eqNullSafe(lost["_d_id"]) & (text_key(docs["text"]) == lost["_d_key"]), "left")
    lines = F.split(F.col("text"), "\n")
    rest = lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_d_lost")), lambda i: F.get(x, i)), "\n")
    text = F.when(F.col("_d_lost").isNull(), F.col("text")).otherwise(let(lines, rest)).alias("text")
    own = [text if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*own, F.coalesce(F.size(lines), F.lit(0)).alias("_lines"), F.coalesce(F.size("_d_lost"), F.lit(0)).alias("_removed"))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", F.col("_lines").cast("long").alias("n_lines"), F.col("_removed").cast("long").alias("n_removed"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_left"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op7_sql() -> str:
    return r"""
WITH lines AS (
  SELECT d.doc_id, d.text, u.line, u.i FROM documents d,
  LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS i) u
), worded AS (
  SELECT doc_id, i, line, row_number() OVER w AS k, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c, lead(i, 1) OVER w AS ib, lead(i, 2) OVER w AS ic
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), spans AS (
  SELECT doc_id, i, ib, ic, row_number() OVER (PARTITION BY line, b, c ORDER BY doc_id, i) AS nth FROM worded WHERE c IS NOT NULL
), lost AS (
  SELECT DISTINCT doc_id, unnest([i, ib, ic]) AS i FROM spans WHERE nth > 1
), rest AS (
  SELECT l.doc_id, count(*) AS n_lines, count(x.i) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE x.i IS NULL), '') AS text
  FROM lines l LEFT JOIN lost x ON l.doc_id = x.doc_id AND l.i = x.i GROUP BY l.doc_id
)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, CAST(length(text) AS BIGINT) AS n_chars_left, md5(text) AS text_md5 FROM rest
"""
