r"""Quality rules with risk-controlled thresholds.

Every document gets counts over its whole text. A rule rejects a document whose value is above the rule's cutoff in its
stratum (its language). Cutoffs come from labelled holdouts: of the n documents labelled good in a stratum, k are above a
candidate. The candidate is safe if the exact binomial tail P(X <= k), X ~ Binomial(n, risk), is at most ``delta`` divided
by the number of strata and rules (Bonferroni); this is the Clopper-Pearson upper bound on the rate of false rejection lying
under the risk. Candidates of one rule are tested in a fixed order, from the most lenient on up to the first that fails, which
needs no further correction; as k grows with strictness, that is the strictest candidate that passes. ``max_false_rejection`` is shared out evenly over the rules, so that the sum over
rules keeps to it in each stratum, with confidence 1 - delta for all strata together. The smallest safe cutoff is taken; a
stratum without a safe one has no cutoff, and its documents pass that rule.

Defined results: a null or empty text has no words, fails the base rule and is not kept. A null language is a stratum of
its own. A document whose labels disagree counts as bad. Rows that repeat a document are judged each; a labelled document
counts as often as it is there. A null id has no label. Columns other than those named are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, WS, table, written

SYMBOLS, WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = "#*$%&|<>", 5, 10, 20
MAX_FALSE_REJECTION, DELTA = 0.02, 0.05
#: Candidate cutoffs of each rule, from strict to lenient; all rules reject what is above.
RULES: dict[str, list[float]] = {
    "symbols_per_word": [0.05 * i for i in range(1, 21)],
    "dup_lines_per_line": [0.05 * i for i in range(1, 20)],
    "repeats_per_word": [0.01 * i for i in range(1, 21)],
    "word_length": [6.0 + i for i in range(20)],
    "word_shortness": [1 / x for x in (6.0, 5.5, 5.0, 4.5, 4.0, 3.5, 3.0, 2.5, 2.0, 1.5)],
}


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of each window of five words; texts of under six words have no two windows."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) > WINDOW, hashes).otherwise(F.array().cast("array<long>"))


def measured(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text, stratum). Counts over the whole text instead of the text."""
    base = docs.select("doc_id", "stratum", F.coalesce("text", F.lit("")).alias("text"))
    filled = F.filter(F.split("text", "\n", -1), lambda x: F.char_length(F.btrim(x, F.lit(WS))) > 0)
    split = base.select(
        "doc_id",
        "stratum",
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.regexp_replace("text", r"[\x20\x09-\x0D]+", "").alias("dense"),
        F.when(F.contains("text", F.lit("\n")), filled).alias("lines"),
    )
    counted = split.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.char_length("dense").cast("long").alias("word_chars"),
        F.regexp_count("dense", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.coalesce(F.size("lines"), F.lit(1)).cast("long").alias("n_lines"),
        window_hashes(F.col("words")).alias("h"),
    )
    # Most texts repeat no window; only the others are sorted, so that equal windows are neighbours.
    order = F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    counted = counted.withColumn("p", F.when(F.size(F.array_distinct("h")) < F.size("h"), order)).drop("h")
    twice = lambda x, j: F.when((F.get("p", j - 1)["h"] == x["h"]) | (F.get("p", j + 1)["h"] == x["h"]), x["i"])
    starts = F.array_sort(F.filter(F.transform("p", twice), lambda i: i.isNotNull()))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last"))
    repeats = F.coalesce(F.aggregate("s", zero, step, lambda a: a["n"]), F.lit(0)).cast("long")
    return counted.withColumn("s", starts).withColumn("n_repeat_words", repeats).drop("p", "s")


def values() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_lines_per_line": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats_per_word": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
        "word_shortness": words / F.greatest(F.col("word_chars"), F.lit(1)),
    }


def binomial_tail(n: Column, k: Column, risk: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, risk), summed exactly term by term in logarithms."""
    import math

    odds = math.log(risk) - math.log1p(-risk)
    first = n * F.lit(math.log1p(-risk))
    zero = F.struct(first.alias("term"), first.alias("sum"))

    def step(a, i):
        term = a["term"] + F.log(n - i + 1) - F.log(i) + F.lit(odds)
        high, low = F.greatest(term, a["sum"]), F.least(term, a["sum"])
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(terms, zero, step, lambda a: F.exp(a["sum"]))


def safe_cutoffs(counts: DataFrame, labels: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> DataFrame:
    """(stratum, cuts): the smallest safe cutoff of each rule, by name. labels: (doc_id, quality)."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("quality")).where("quality = 1")
    held = counts.join(good, F.col("doc_id") == F.col("label_id"))
    risk = max_false_rejection / len(RULES)
    grid = {rule: F.array(*map(F.lit, cutoffs)) for rule, cutoffs in RULES.items()}
    # A value is above the first ``above`` candidates of its rule.
    passed = lambda cutoffs, value: F.size(F.filter(cutoffs, lambda c: c < value))
    above = [F.struct(F.lit(r).alias("rule"), passed(grid[r], v).alias("above")) for r, v in values().items()]
    tallies = held.select("stratum", F.inline(F.array(*above))).groupBy("stratum", "rule").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("above") >= i).alias(f"k{i}") for i in range(1, 21)]
    )
    n_tests = F.count(F.lit(1)).over(W.partitionBy())  # a row for each stratum and rule
    tests = tallies.withColumn("n_tests", n_tests).select("stratum", "rule", "n", "n_tests", F.posexplode(F.array(*[F.col(f"k{i}") for i in range(1, 21)])).alias("i", "k"))
    tests = tests.withColumn("cutoff", F.get(F.element_at(F.create_map(*[x for r in RULES for x in (F.lit(r), grid[r])]), F.col("rule")), F.col("i"))).where("cutoff IS NOT NULL")
    # From k >= n * risk on the tail is about a half or more.
    safe = tests.where((F.col("k") < F.col("n") * risk)).where(binomial_tail(F.col("n"), F.col("k"), risk) <= F.lit(delta) / F.col("n_tests"))
    best = safe.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))


def judged(counts: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """counts with base_failed, failed_rules and kept."""
    cuts = cutoffs.select(F.col("stratum").alias("cut_stratum"), "cuts")
    joined = counts.join(cuts, counts["stratum"].eqNullSafe(cuts["cut_stratum"]), "left")
    failed = F.filter(F.array(*[F.when(v > F.element_at("cuts", F.lit(r)), F.lit(r)) for r, v in values().items()]), lambda r: r.isNotNull())
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = joined.withColumn("base_failed", base).withColumn("failed_rules", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("cut_stratum", "cuts")


def quality_rules(docs: DataFrame, labels: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> DataFrame:
    """docs: (doc_id, text, stratum); labels: (doc_id, quality). One row per document with counts and verdicts."""
    counts = written(measured(docs), "rule-counts")
    return judged(counts, safe_cutoffs(counts, labels, max_false_rejection, delta))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("stratum"))
    out = quality_rules(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    grids = ", ".join(f"('{r}', {c!r}::DOUBLE[])" for r, c in RULES.items())
    risk = MAX_FALSE_REJECTION / len(RULES)
    return rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(text, E'\n'), lambda x: trim(x, E' \t\n\x0b\x0c\r') <> '') AS l FROM t),
win AS (SELECT doc_id, i, [w[i], w[i+1], w[i+2], w[i+3], w[i+4]] AS g FROM t, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(5) r(k) GROUP BY doc_id),
c AS (SELECT t.doc_id, t.lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        CASE WHEN contains(text, E'\n') THEN len(l) ELSE 1 END AS n_lines, coalesce(cov.n, 0) AS n_repeat_words
      FROM t JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id)),
v AS (SELECT *, unnest([{{'rule': 'symbols_per_word', 'value': n_symbols / greatest(n_words, 1)}}, {{'rule': 'dup_lines_per_line', 'value': n_dup_lines / greatest(n_lines, 1)}},
        {{'rule': 'word_length', 'value': word_chars / greatest(n_words, 1)}},
        {{'rule': 'word_shortness', 'value': greatest(n_words, 1) / greatest(word_chars, 1)}}], recursive := true) FROM c),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
grid AS (SELECT rule, unnest(cuts) AS cutoff FROM (VALUES {grids}) AS g(rule, cuts)),
k AS (SELECT v.lang, v.rule, g.cutoff, count(*) AS n, count(*) FILTER (WHERE v.value > g.cutoff) AS k FROM v JOIN good USING (doc_id) JOIN grid g ON v.rule = g.rule GROUP BY ALL),
p AS (SELECT *, (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk!r}) + (n - j) * ln(1 - {risk!r}))) FROM range(k + 1) r(j)) AS tail FROM k WHERE k < n * {risk!r}),
s AS (SELECT lang, rule, min(cutoff) AS cutoff FROM p WHERE tail <= {DELTA!r} / (SELECT count(*) FROM (SELECT DISTINCT lang, rule FROM k)) GROUP BY lang, rule),
bad AS (SELECT DISTINCT v.doc_id FROM v JOIN s ON v.lang IS NOT DISTINCT FROM s.lang AND v.rule = s.rule WHERE v.value > s.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM c
"""


ORACLE = _oracle()
