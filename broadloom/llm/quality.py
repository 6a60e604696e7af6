"""Quality rules with risk-controlled thresholds, in column expressions only.

A document fails the base rules, or exceeds a certified cutoff of a rule's rate in its stratum (language). A
cutoff is certified on the labelled holdout of the stratum: with ``n`` good documents of which ``k`` exceed it, the
exact binomial tail ``P(Bin(n, RULE_RISK) <= k)`` is at most ``CONFIDENCE_LOSS / (strata x rules)``. The tail only
grows from a loose cutoff to a tighter one, so going from loose to tight until the first failure is a fixed-sequence
test: its level needs no share per cutoff, the Bonferroni share covers strata and rules. With probability
``1 - CONFIDENCE_LOSS`` every rule rejects at most ``RULE_RISK`` of the good documents of every stratum at once, all
rules together ``RULE_RISK x rules``. Among the certified cutoffs that one is taken which rejects most bad less good
labelled documents, the loosest on ties; a rule without a gain, or a stratum with too few labels, has no cutoff.

Statistics and thresholds use all documents and all labels. Null texts have no words, null strata form the stratum
``''``, null labels are left out, a document labelled twice counts twice. Extra columns are kept by
:func:`keep_good` and left out of :func:`verdicts`. Empty tables give empty results; without labels only the base
rules decide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadloom.llm.common import SPACES, columns_of, free_name
from broadloom.session import stage

#: Share of good documents that a rule may reject in a stratum, and the probability that some guarantee fails.
RULE_RISK = 0.01
CONFIDENCE_LOSS = 0.05
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

#: Rules: rate in thousandths over the measures, and the cutoffs that are tried.
RULES = {
    "symbols": ("1000 * n_symbols div greatest(word_chars, 1)", (10, 20, 50, 100, 200, 300)),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", (100, 200, 300, 400, 500, 600, 700, 800)),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1)", (100, 150, 200, 250, 300, 350, 400, 450)),
    "capitals": ("1000 * n_capitals div greatest(word_chars, 1)", (100, 150, 200, 300, 400, 500, 600)),
}
_WHITE = "concat(' ', char(9), char(10), char(11), char(12), char(13))"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "base_failed")


def measures(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with a struct column ``name`` of the measures.

    The words found in repeated 3-word windows are counted from sorted (hash, position) pairs: equal neighbours
    mark window starts, and each start covers the words up to the next start, three at most. Write the result before
    filtering it: a filter pushed below would repeat the array expressions inside one another.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    h = F.transform(F.array_remove(F.split(t, SPACES), ""), lambda x: F.xxhash64(x))
    out = df.select(F.struct(*columns_of(df)).alias("_row"), t.alias("_t"), h.alias("_h"))
    out = out.withColumn("_g", F.expr("if(size(_h) < 3, cast(array() as array<bigint>), transform(slice(_h, 1, size(_h) - 2), (x, i) -> xxhash64(x, _h[i + 1], _h[i + 2])))"))
    pairs = "if(size(array_distinct(_g)) < size(_g), sort_array(transform(_g, (x, i) -> struct(x as h, i as p))), null)"
    out = out.withColumn("_s", F.expr(pairs))
    starts = "filter(_s, (x, j) -> coalesce(get(_s, j - 1).h = x.h, false) or coalesce(get(_s, j + 1).h = x.h, false))"
    out = out.withColumn("_p", F.expr(f"sort_array(transform({starts}, x -> x.p))"))
    out = out.withColumn("_l", F.expr(f"filter(split(_t, '\\n'), l -> translate(l, {_WHITE}, '') != '')"))
    out = out.withColumn("_n", F.expr("cast(size(_h) as bigint)"))
    out = out.withColumn("_r", F.expr("coalesce(aggregate(zip_with(_p, slice(_p, 2, size(_p)), (a, b) -> least(3, b - a)), 0L, (n, x) -> n + x), 0L)"))
    fields = {
        "n_words": "_n",
        "word_chars": f"cast(length(translate(_t, {_WHITE}, '')) as bigint)",
        "n_symbols": "cast(length(_t) - length(translate(_t, '#*$%&|<>', '')) as bigint)",
        "n_dup_lines": "cast(size(_l) - size(array_distinct(_l)) as bigint)",
        "n_repeat_words": "_r",
        "n_lines": "cast(size(_l) as bigint)",
        "n_capitals": "cast(length(_t) - length(translate(_t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) as bigint)",
        "base_failed": f"_n < {LEAST_WORDS} or 100 * _r > {MOST_REPEATED_PERCENT} * _n",
    }
    return out.select("_row.*", F.expr("struct(" + ", ".join(f"{e} as {n}" for n, e in fields.items()) + ")").alias(name))


def tail(n: Column, k: Column, share: float) -> Column:
    """``P(Bin(n, share) <= k)``, summed in logarithms term by term."""
    steps = F.when(k < 1, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("bigint"), F.greatest(k, F.lit(1)).cast("bigint")))
    first = n * F.lit(math.log1p(-share))
    start = F.struct(first.alias("log"), F.exp(first).alias("sum"))

    def add(so_far: Column, j: Column) -> Column:
        log = so_far["log"] + F.ln((n - j + 1).cast("double") / j) + F.lit(math.log(share / (1 - share)))
        return F.struct(log.alias("log"), (so_far["sum"] + F.exp(log)).alias("sum"))

    return F.aggregate(steps, start, add)["sum"]


def cutoffs(measured: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", name: str = "m") -> DataFrame:
    """``stratum, <rule>_cutoff`` per stratum with a certified cutoff; null where a rule has none.

    Everything behind the join of the labels is an aggregate of ``strata x rules x cutoffs`` rows.
    """
    stratum_of = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    seen = labels.where("quality is not null").select(F.col(key), (F.col("quality") == 1).alias("good"))
    held = measured.where(f"not {name}.base_failed").select(F.col(key), stratum_of.alias("stratum"), F.col(f"{name}.*")).join(seen, key)
    counts = []
    for rule, (rate, tried) in RULES.items():
        for c in tried:
            over = F.expr(rate) > c
            counts.append(F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.count_if(over & F.col("good")).alias("k"), F.count_if(over & ~F.col("good")).alias("bad")))
    per = held.groupBy("stratum").agg(F.count_if("good").alias("n"), F.array(*counts).alias("cells"))
    cells = per.select("stratum", "n", F.inline("cells"))
    share = F.lit(CONFIDENCE_LOSS / len(RULES)) / F.greatest(F.lit(1), F.lit(per.count()))
    best = (
        cells.where((tail(F.col("n"), F.col("k"), RULE_RISK) <= share) & (F.col("bad") > F.col("k")))
        .groupBy("stratum", "rule")
        .agg(F.max(F.struct((F.col("bad") - F.col("k")).alias("gain"), "cutoff")).alias("best"))
    )
    chosen = [F.max(F.when(F.col("rule") == r, F.col("best.cutoff"))).alias(f"{r}_cutoff") for r in RULES]
    return best.groupBy("stratum").agg(*chosen)


def _judged(measured: DataFrame, found: DataFrame, stratum: str, name: str, verdict: str) -> DataFrame:
    """``measured`` with the boolean ``verdict``: kept or not."""
    rows = measured.select(F.struct(*columns_of(measured)).alias("_row"), F.coalesce(measured[stratum].cast("string"), F.lit("")).alias("_stratum"))
    limits = found.select(F.col("stratum").alias("_stratum"), F.struct(*(f"{r}_cutoff" for r in RULES)).alias("_limits"))
    over = F.col(f"_row.{name}.base_failed")
    for rule, (rate, _) in RULES.items():
        for m in MEASURES:
            rate = rate.replace(m, f"_row.{name}.{m}")
        over = over | F.coalesce(F.expr(rate) > F.col(f"_limits.{rule}_cutoff"), F.lit(False))
    return rows.join(limits, "_stratum", "left").select("_row.*", (~over).alias(verdict))


def verdicts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of query ``op7_quality``: measures, base verdict and final verdict of each document."""
    measured = stage(measures(documents.select("doc_id", "lang", "text"), "text", "m").drop("text"), "quality")
    found = stage(cutoffs(measured, labels), "quality-cutoffs")
    out = _judged(measured, found, "lang", "m", "kept")
    return out.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "m.base_failed", "kept")


def keep_good(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """The documents that pass, with the columns they had."""
    name, kept = free_name(documents, "_m"), free_name(documents, "_kept")
    measured = stage(measures(documents, text, name), "quality-measures")
    found = stage(cutoffs(measured, labels, key, stratum, name), "quality-cutoffs")
    return _judged(measured, found, stratum, name, kept).where(F.col(kept)).select(*columns_of(documents))


def _sql() -> str:
    rates = {r: e.replace(" div ", " // ") for r, (e, _) in RULES.items()}
    cells = ", ".join(f"('{r}', {c})" for r, (_, cs) in RULES.items() for c in cs)
    rate = "CASE rule " + " ".join(f"WHEN '{r}' THEN {e}" for r, e in rates.items()) + " END"
    white = "[\\x20\\x09-\\x0D]"
    word = "[^\\x20\\x09-\\x0D]"
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '{word}+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{word}')) AS l FROM documents),
win AS (SELECT doc_id, i, w[i : i + 2] AS x FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
m AS (
    SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{white}', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
        length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals
    FROM d LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM m),
held AS (SELECT b.*, quality = 1 AS good FROM b JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IS NOT NULL),
c AS (
    SELECT stratum, rule, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND {rate} > cutoff) AS k,
        count(*) FILTER (NOT good AND {rate} > cutoff) AS bad
    FROM held, (VALUES {cells}) AS v(rule, cutoff) GROUP BY ALL),
p AS (
    SELECT *, (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RULE_RISK}) + (n - j) * ln(1 - {RULE_RISK})))
            FROM (SELECT unnest(generate_series(0, k)) AS j)) AS tail, (SELECT count(DISTINCT stratum) FROM held) AS strata FROM c WHERE n > 0),
best AS (
    SELECT stratum, rule, arg_max(cutoff, (bad - k, cutoff)) AS cutoff FROM p
    WHERE (n < 1 OR tail <= {CONFIDENCE_LOSS} / {len(RULES)} / strata) AND bad > k GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT EXISTS (SELECT 1 FROM best WHERE best.stratum = b.stratum AND {rate} > best.cutoff) AS kept
FROM b
"""


SQL = _sql()
