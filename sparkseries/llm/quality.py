"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each document gets counts (see ``features``) and the ratios the rules look at.
A *ladder* of strictness levels sets one cutoff per rule and level; a document is
rejected at a level when any rule passes its cutoff, so levels are nested.

Which level a stratum (language) uses is decided on labelled documents of good
quality that were used for nothing else.  For each level the number k of them it
rejects out of n gives the exact binomial tail P(Bin(n, limit) <= k): the
p-value of "this level rejects more than ``limit`` of the good documents".
Levels are tested from the mildest on and testing stops at the first that is not
significant (a fixed sequence, which needs no correction within a stratum); the
significance is divided by the number of strata (Bonferroni).  So with
probability ``1 - risk`` no stratum loses more than ``limit`` of its good
documents.  A stratum with too few labels rejects nothing beyond the base rules.

Everything about a text is computed inside its row: no words are shuffled.  Narrow
rows are joined with the labels and counted with map-side combining.  Windows of
words are compared by 64-bit hashes within one text (of 20,000 words, two different
ones meet with a chance of 1 in 10^11).

Defined cases: null text has no words (and fails the base rules); null ids are
kept and match no label; a label row counts once however often it is repeated, a
document labelled both good and bad is not used; a null language is a stratum of
its own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import stored

SPACE = "[\\x20\\x09-\\x0D]+"
WINDOW = 5
#: Share of good documents of a stratum that may be rejected, and the risk that more are.
LIMIT, RISK = 0.01, 0.05
#: Rule -> cutoffs from the mildest level to the strictest.
LADDER = {
    "symbols_per_word": [1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25],
    "capital_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25],
    "shouts_per_word": [1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15],
    "word_length": [24.0, 22.0, 20.0, 18.0, 16.0, 15.0, 14.0, 13.0, 12.5, 12.0],
}
LEVELS = 10


def _repeat_words(words: Column) -> Column:
    """Struct array (hash of the window, its place), sorted by hash."""
    n = F.size(words)
    pair = F.zip_with(words, F.slice(words, 2, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    four = F.zip_with(pair, F.slice(pair, 3, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    five = F.zip_with(four, F.slice(words, WINDOW, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    five = F.slice(five, 1, F.greatest(n - (WINDOW - 1), F.lit(0)))
    return F.sort_array(F.transform(five, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One narrow row per row of ``docs``: id, stratum, the counts and the rules' ratios."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(stratum_col), F.lit("")).alias("stratum"), text.alias("t"))
    rows = rows.withColumn("words", F.filter(F.split("t", SPACE), lambda w: w != ""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = rows.select("id", "stratum", "t", "words", _repeat_words(F.col("words")).alias("windows"), lines.alias("lines"))
    places = F.flatten(
        F.zip_with("windows", F.slice("windows", 2, F.greatest(F.size("windows"), F.lit(1))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    )
    rows = rows.select(
        "id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.char_length(F.regexp_replace("t", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.char_length(F.regexp_replace("t", "[^!]+", "")).cast("long").alias("n_shouts"),
        F.sort_array(F.array_distinct(places)).alias("places"),
    )
    steps = F.zip_with("places", F.slice("places", 2, F.greatest(F.size("places"), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    rows = rows.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)).drop("places")
    per_word = F.greatest(F.col("n_words"), F.lit(1))
    return rows.select(
        "id",
        "stratum",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("n_symbols") / per_word).alias("symbols_per_word"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_share"),
        (F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1))).alias("capital_share"),
        (F.col("n_shouts") / per_word).alias("shouts_per_word"),
        (F.col("word_chars") / per_word).alias("word_length"),
    )


def _rejected_at(level: int) -> Column:
    out = F.lit(False)
    for rule, cutoffs in LADDER.items():
        out = out | (F.col(rule) > cutoffs[level])
    return out


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed exactly in logarithms; 1 where k is at or above the mean."""
    import math

    odds = math.log(p / (1 - p))
    start = n * math.log1p(-p)
    term = lambda acc, i: acc["t"] + F.log((n - i + 1) / i) + odds
    bigger = lambda a, b: F.greatest(a, b) + F.log1p(F.exp(F.least(a, b) - F.greatest(a, b)))
    sum_ = F.aggregate(
        F.filter(F.sequence(F.lit(0).cast("long"), F.least(k, F.ceil(n * p).cast("long"))), lambda i: i > 0),
        F.struct(start.alias("t"), start.alias("s")),
        lambda acc, i: F.struct(term(acc, i).alias("t"), bigger(acc["s"], term(acc, i)).alias("s")),
        lambda acc: F.exp(acc["s"]),
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(sum_)


def certified_levels(feats: DataFrame, labels: DataFrame, *, label_id: str = "doc_id", limit: float = LIMIT, risk: float = RISK) -> DataFrame:
    """(stratum, level): how many ladder levels are certified for each stratum that has labels."""
    good = labels.filter(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("label_id")).agg(F.min("quality").alias("q")).filter("q = 1").select("label_id")
    held_out = feats.filter(~_base_failed()).join(good, F.col("id") == F.col("label_id"))
    counts = held_out.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.sum(_rejected_at(j).cast("long")).alias(f"k{j}") for j in range(LEVELS)])
    counts = stored(counts, "quality_counts")
    strata = max(1, counts.count())
    passed = F.array(*[binomial_tail(F.col("n"), F.col(f"k{j}"), limit) <= risk / strata for j in range(LEVELS)])
    run = F.aggregate(passed, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, ok: F.struct((acc["n"] + (acc["on"] & ok).cast("int")).alias("n"), (acc["on"] & ok).alias("on")), lambda acc: acc["n"])
    return counts.select("stratum", run.alias("level"))


def _base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", limit: float = LIMIT, risk: float = RISK) -> DataFrame:
    """One row per row of ``docs``: id, the counts, base_failed, kept, and the certified level of its stratum."""
    feats = stored(features(docs, id_col=id_col, text_col=text_col, stratum_col=stratum_col), "quality_features")
    levels = _small(certified_levels(feats, labels, limit=limit, risk=risk))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return _verdicts(feats, levels).select(F.col("id").alias(id_col), *counts, "base_failed", "kept", "level")


def _small(levels: DataFrame) -> DataFrame:
    """Broadcast the levels if the strata (languages) are few, as counted here."""
    return F.broadcast(levels) if levels.count() <= 10_000 else levels


def _verdicts(feats: DataFrame, levels: DataFrame) -> DataFrame:
    rows = feats.join(levels.withColumnRenamed("stratum", "s2"), F.col("stratum") == F.col("s2"), "left").withColumn("level", F.coalesce("level", F.lit(0)))
    rejected = F.lit(False)
    for j in range(LEVELS):
        rejected = rejected | ((F.col("level") == j + 1) & _rejected_at(j))
    return rows.withColumns({"base_failed": _base_failed(), "kept": ~_base_failed() & ~rejected})


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``docs`` without the rejected ones; the features of a text are computed once.

    The verdict of a row follows from its own text and stratum, so rows that share
    an id each get their own.  Rows are stored with their features: writing and
    reading them costs far less than computing the features a second time, and no
    text is moved or joined by id.
    """
    key = F.struct(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"))
    wide = docs.select(key.alias("key"), F.col(text_col).alias("text"), F.col(stratum_col).alias("lang"))
    rows = stored(features(wide, id_col="key"), "quality_rows")
    levels = _small(certified_levels(rows.withColumn("id", F.col("id.id")), labels))
    return _verdicts(rows, levels).filter("kept").select("id.row.*")


def oracle(limit: float = LIMIT, risk: float = RISK) -> str:
    """DuckDB SQL for the rows of ``judge`` on documents and labels."""
    rejected = [" OR ".join(f"{rule} > {c[j]}" for rule, c in LADDER.items()) for j in range(LEVELS)]
    counts = ", ".join(f"sum(CASE WHEN {r} THEN 1 ELSE 0 END)::BIGINT AS k{j}" for j, r in enumerate(rejected))
    ladder = " UNION ALL ".join(f"SELECT stratum, n, {j} AS j, k{j} AS k FROM counts" for j in range(LEVELS))
    verdict = " OR ".join(f"(level = {j + 1} AND ({r}))" for j, r in enumerate(rejected))
    tail = f"(SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({limit}) + (n - i) * ln(1 - {limit}))) FROM (SELECT unnest(range(0, k + 1)) AS i))"
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
win AS (SELECT doc_id, i, words[i:i+4] AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, win FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT win.doc_id, win.i, unnest(range(0, 5)) AS o FROM win JOIN twice ON win.doc_id = twice.doc_id AND win.win = twice.win) GROUP BY doc_id),
c AS (SELECT w.doc_id, stratum, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
      length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
      length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals, length(t) - length(replace(t, '!', '')) AS n_shouts, coalesce(rep.n, 0) AS n_repeat_words
      FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
f AS (SELECT *, n_symbols / greatest(n_words, 1) AS symbols_per_word, n_dup_lines / greatest(n_lines, 1) AS dup_line_share, n_capitals / greatest(word_chars, 1) AS capital_share,
      n_shouts / greatest(n_words, 1) AS shouts_per_word, word_chars / greatest(n_words, 1) AS word_length, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
counts AS (SELECT stratum, count(*) AS n, {counts} FROM f WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY stratum),
tests AS (SELECT stratum, j, CASE WHEN k >= n * {limit} THEN false ELSE {tail} <= {risk} / (SELECT count(*) FROM counts) END AS ok FROM ({ladder})),
levels AS (SELECT stratum, coalesce(min(CASE WHEN NOT ok THEN j END), {LEVELS}) AS level FROM tests GROUP BY stratum)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({verdict}, false) AS kept, CAST(coalesce(level, 0) AS INTEGER) AS level
FROM f LEFT JOIN levels USING (stratum)
"""
