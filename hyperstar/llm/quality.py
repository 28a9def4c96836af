"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose metric lies above a cutoff. The cutoff of a
rule in a stratum is the lowest of a fixed grid for which an exact binomial
bound on labelled good documents certifies that the rule rejects at most
``risk / number of rules`` of the stratum's good documents. All tests of rules,
cutoffs and strata share the error ``delta`` (Bonferroni), so with probability
``1 - delta`` no stratum loses more than ``risk`` of its good documents to the
rules. A stratum with too few labelled documents to certify any cutoff keeps
what the base rules keep.

Only DataFrame functions are used. The texts are read once: their counts go to
a narrow table in the shared folder, and all later steps work on numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, table, text_key, words, written

#: Strata by language; any other or no language is stratum "other". Fixed, so the table of cutoffs has a fixed size.
STRATA = ("en", "de", "fr", "es")
#: Share of a stratum's good documents that the rules may reject, and the chance that the guarantee fails.
RISK, DELTA = 0.03, 0.1
#: rule -> cutoffs from loose to strict. A metric above the cutoff rejects.
GRID = {
    "symbols": (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "dup_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2),
    "repeats": (0.19, 0.18, 0.16, 0.14, 0.12, 0.1),
    "long_words": (30.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0),
    "short_words": (-2.0, -2.5, -3.0, -3.5),
}
TESTS = (len(STRATA) + 1) * sum(map(len, GRID.values()))
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20


def _repeated(hashes: Column) -> Column:
    """Words covered by the windows of a text whose hash is found twice or more in it."""

    def covered(placed: Column) -> Column:
        same = lambda e, k: F.coalesce(F.get(placed, k)["h"] == e["h"], F.lit(False))
        twice = F.filter(placed, lambda e, k: same(e, k - 1) | same(e, k + 1))
        starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
        return let(starts, lambda s: F.aggregate(F.transform(s, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, covered))


def counts(docs: DataFrame, *more: Column) -> DataFrame:
    """The counts of every text, one row per row of ``docs``: doc_id, row_key, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, and ``more``."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def of_words(w: Column) -> Column:
        windows = F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<long>"))
        return F.struct(F.size(w).cast("long").alias("n_words"), let(windows, _repeated).cast("long").alias("n_repeat_words"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    stratum = F.when(F.col("lang").isin(*STRATA), F.col("lang")).otherwise(F.lit("other"))
    found = docs.select(
        "doc_id", text_key(F.col("text")).alias("row_key"), stratum.alias("stratum"), let(words(F.col("text")), of_words).alias("w"), of_lines.alias("l"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"), (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"), *more,
    )
    return found.select("doc_id", "row_key", "stratum", "w.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words", *found.columns[7:])


def metrics() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / n,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / n,
        "long_words": F.col("word_chars") / n,
        "short_words": -(F.col("word_chars") / n),
    }


def _log_gamma(x: Column) -> Column:
    """Stirling's series eight steps up, exact to about 1e-13 for x >= 1."""
    y = x + 8.0
    rise = F.log(x)
    for k in range(1, 8):
        rise = rise + F.log(x + float(k))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - rise


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p) and k below n * p: the terms from k down,
    each from the one before. Past some tens of standard deviations they are
    zero in double precision, so the sum is exact with O(sqrt(n)) terms."""
    log_top = _log_gamma(n + 1.0) - _log_gamma(k + 1.0) - _log_gamma(n - k + 1.0) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    terms = F.least(k, F.ceil(60 * F.sqrt(n * p) + 60).cast("double")).cast("int")
    start = F.struct(F.exp(log_top).alias("t"), F.exp(log_top).alias("s"))

    def step(a: Column, j: Column) -> Column:
        t = a["t"] * (k - j) / (n - k + j + 1.0) * ((1 - p) / p)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    return F.aggregate(F.sequence(F.lit(0), terms), start, step, lambda a: a["s"])


def cutoffs(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per stratum with a column per rule: its certified cutoff, or null. At most ``len(STRATA) + 1`` rows.

    ``labels`` has doc_id and quality; a document counts as good if all its labels say 1.
    """
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_good")).where("_good = 1").select("doc_id")
    level = {r: F.size(F.filter(F.array(*map(F.lit, GRID[r])), lambda c, m=m: m > c)) for r, m in metrics().items()}
    seen = counted.join(good, "doc_id").select("stratum", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), v.alias("b")) for r, v in level.items()))).alias("x")).select("stratum", "x.rule", "x.b", F.lit(1).alias("n"))
    each = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(b).alias("b")) for r, g in GRID.items() for b in range(len(g) + 1)))
    empty = counted.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, (*STRATA, "other")))).alias("stratum")).select("stratum", F.explode(each).alias("x")).select("stratum", "x.rule", "x.b", F.lit(0).alias("n"))
    # A document that passes b cutoffs, from the loosest on, is rejected by the first b of them.
    at = Window.partitionBy("stratum", "rule")
    rejected = (
        seen.groupBy("stratum", "rule", "b").agg(F.sum("n").alias("n")).unionByName(empty).groupBy("stratum", "rule", "b").agg(F.sum("n").alias("n"))
        .select("stratum", "rule", "b", F.sum("n").over(at).cast("double").alias("n"), F.sum("n").over(at.orderBy(F.desc("b"))).cast("double").alias("k"))
        .where("b > 0")
    )
    risk = RISK / len(GRID)
    sure = rejected.where(F.when(F.col("k") < F.col("n") * risk, binomial_tail(F.col("n"), F.col("k"), risk) <= DELTA / TESTS).otherwise(False))
    strictest = sure.groupBy("stratum", "rule").agg(F.max("b").alias("b"))
    value = lambda r: F.max(F.when(F.col("rule") == r, F.element_at(F.array(*map(F.lit, GRID[r])), F.least(F.col("b"), F.lit(len(GRID[r]))))))
    return strictest.groupBy("stratum").agg(*(value(r).alias(f"cut_{r}") for r in GRID))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The verdict on every row of ``docs``: doc_id, row_key, the counts, base_failed and kept.

    Null texts and empty texts have no words and fail the base rules. A null
    doc_id gets a verdict but never calibrates. Rows that repeat a doc_id are
    judged each by its own text. Further columns of either table are ignored.
    An empty table gives an empty result; with no labels only the base rules
    reject.
    """
    return _judged(written(counts(docs)), labels)


def _judged(counted: DataFrame, labels: DataFrame) -> DataFrame:
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    above = F.lit(False)
    for rule, metric in metrics().items():
        above = above | F.coalesce(metric > F.col(f"cut_{rule}"), F.lit(False))
    judged = counted.join(F.broadcast(cutoffs(counted, labels)), "stratum", "left")  # five rows at most
    return judged.select("doc_id", "row_key", "stratum", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~above).alias("kept"), *counted.columns[9:])


def op3(spark, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its own columns. The rows go to the shared folder beside their counts, so that the verdict needs no shuffle of texts."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    return _judged(written(counts(docs, row)), labels).where("kept").select("_row.*")


def op3_sql() -> str:
    grid = ", ".join(f"('{r}', {b + 1}, CAST({c} AS DOUBLE))" for r, g in GRID.items() for b, c in enumerate(g))
    strata = ", ".join(f"'{s}'" for s in STRATA)
    risk = RISK / len(GRID)
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, CASE WHEN lang IN ({strata}) THEN lang ELSE 'other' END AS stratum, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, ws[i:i + {WINDOW - 1}] AS g FROM w, LATERAL (SELECT unnest(range(1, len(ws) - {WINDOW - 2})) AS i)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY doc_id
), counted AS (
  SELECT w.doc_id, stratum, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)
), measured AS (
  SELECT *, len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_symbols / greatest(n_words, 1) AS symbols, (len(ls) - len(list_distinct(ls))) / greatest(len(ls), 1) AS dup_lines,
    n_repeat_words / greatest(n_words, 1) AS repeats, word_chars / greatest(n_words, 1) AS long_words, -(word_chars / greatest(n_words, 1)) AS short_words FROM counted
), long AS (
  UNPIVOT (SELECT doc_id, stratum, symbols, dup_lines, repeats, long_words, short_words FROM measured) ON symbols, dup_lines, repeats, long_words, short_words INTO NAME rule VALUE metric
), grid(rule, b, cutoff) AS (VALUES {grid}), good AS (
  SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1
), held AS (
  SELECT stratum, rule, b, cutoff, count(*) AS n, count(*) FILTER (WHERE metric > cutoff) AS k FROM long JOIN good USING (doc_id) JOIN grid USING (rule) GROUP BY ALL
), tail AS (
  SELECT stratum, rule, b, cutoff, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk}))) AS p
  FROM held, LATERAL (SELECT unnest(range(0, k + 1)) AS i) WHERE k < n * {risk} GROUP BY ALL
), cutoffs AS (
  SELECT stratum, rule, arg_max(cutoff, b) AS cutoff FROM tail WHERE p <= {DELTA / TESTS} GROUP BY ALL
), above AS (
  SELECT DISTINCT doc_id FROM long JOIN cutoffs USING (stratum, rule) WHERE metric > cutoff
)
SELECT m.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND a.doc_id IS NULL AS kept
FROM measured m LEFT JOIN above a ON m.doc_id = a.doc_id
"""
