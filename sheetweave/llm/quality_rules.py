"""Quality rules whose cutoffs carry a risk guarantee.

Rules compare a feature of a text with a cutoff.  For every stratum and rule the
strictest cutoff of a fixed ladder is taken for which an exact binomial test on
labelled good texts shows that it rejects at most ``risk / rules`` of them.  The
tests share the error probability ``error`` by Bonferroni's correction, so with
probability ``1 - error`` no stratum loses more than ``risk`` of its good texts to
them.  Texts that fail the base go before and don't count among the good ones
here: what the base rejects isn't covered by the guarantee.
Where a stratum has too few labels for any cutoff, its rules stay off.

Everything is DataFrame expressions: no Python runs in tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import cut

GAP = "[\\x20\\x09-\\x0D]+"
#: name, feature, ladder from mild to strict.  A text is rejected above the cutoff.
RULES = [
    ("symbols", "n_symbols / greatest(word_chars, 1)", [0.3, 0.2, 0.1, 0.05, 0.02]),
    ("dup_lines", "n_dup_lines / greatest(n_lines, 1)", [0.6, 0.4, 0.3, 0.2, 0.1]),
    ("repeats", "n_repeat_words / greatest(n_words, 1)", [0.18, 0.15, 0.12, 0.08, 0.04]),
    ("long_words", "word_chars / greatest(n_words, 1)", [40.0, 25.0, 15.0, 12.0, 10.0]),
]
RISK, ERROR = 0.04, 0.05
#: Strata up to which their cutoffs are broadcast; more are joined by a shuffle.
SMALL = 10_000


def features(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``doc_id, stratum`` and the counts of each whole text; null texts have no words, null strata are ``unknown``."""
    words = F.filter(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), GAP), lambda w: w != "")
    lines = F.filter(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    hashed = F.transform("words", lambda w: F.xxhash64(w))
    windows = F.expr("transform(sequence(0, size(hashes) - 5), i -> xxhash64(hashes[i], hashes[i + 1], hashes[i + 2], hashes[i + 3], hashes[i + 4]))")
    twice = F.expr("filter(sorted, (x, i) -> i > 0 and x = sorted[i - 1])")
    # Only texts with a repeated window are ordered by window and position.
    covered = F.expr("""
        aggregate(
          array_sort(transform(
            filter(
              transform(places, (e, j) -> struct(e.x as x, e.i as i, j as j)),
              e -> (e.j > 0 and places[e.j - 1].x = e.x) or (e.j + 1 < size(places) and places[e.j + 1].x = e.x)
            ), e -> e.i)),
          struct(0L as n, -5 as at),
          (s, i) -> struct(s.n + least(5, i - s.at) as n, i as at),
          s -> s.n)
    """)
    return (
        docs.select(
            F.col(doc_col).alias("doc_id"),
            F.coalesce(F.col(stratum_col).cast("string"), F.lit("unknown")).alias("stratum"),
            words.alias("words"),
            lines.alias("lines"),
            F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit("[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        )
        .withColumn("hashes", hashed)
        .withColumn("windows", F.when(F.size("hashes") >= 5, windows).otherwise(F.expr("array()").cast("array<bigint>")))
        .withColumn("sorted", F.sort_array("windows"))
        .withColumn("twice", F.size(twice))
        .withColumn("places", F.when(F.col("twice") > 0, F.expr("array_sort(transform(windows, (x, i) -> struct(x, i)))")))
        .select(
            "doc_id",
            "stratum",
            F.size("words").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            "n_symbols",
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.size("lines").cast("long").alias("n_lines"),
            F.when(F.col("twice") > 0, covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        )
    )


def base_failed() -> Column:
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), summed term by term in logarithms; 1 where k >= n."""
    terms = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct((n * F.log(F.lit(1 - p))).cast("double").alias("term"), (n * F.log(F.lit(1 - p))).cast("double").alias("total")),
        lambda s, i: F.struct(
            (s["term"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))).cast("double").alias("term"),
            _log_sum(s["total"], s["term"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))).cast("double").alias("total"),
        ),
        lambda s: F.exp(s["total"]),
    )
    return F.when(k >= n, F.lit(1.0)).when(k > p * n, F.lit(1.0)).otherwise(terms)


def _log_sum(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def cutoffs(counted: DataFrame, labels: DataFrame, *, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """``stratum, rule, cutoff, n_good, n_lost`` for each rule that a stratum may apply.

    ``labels`` has ``doc_id, good`` (boolean; nulls are ignored).  An id that is
    labelled more than once counts as good if any of its labels is.  A cutoff
    above which more than ``risk / rules`` of the good texts lie can't pass, so
    its tail isn't summed.
    """
    good = labels.where("good is not null and doc_id is not null").groupBy("doc_id").agg(F.max("good").alias("good")).where("good")
    rungs = [(name, cutoff, f"({feature}) > {cutoff}D") for name, feature, ladder in RULES for cutoff in ladder]
    held = counted.where(~base_failed()).join(good, "doc_id").groupBy("stratum").agg(F.count("*").alias("n_good"), *(F.count_if(F.expr(test)).alias(f"lost_{i}") for i, (_, _, test) in enumerate(rungs)))
    ladder = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(cutoff).alias("cutoff"), F.col(f"lost_{i}").alias("n_lost")) for i, (name, cutoff, _) in enumerate(rungs)))
    # One row; the number of strata is that of the tests.
    strata = held.agg(F.count("*").alias("strata"))
    each = held.select("stratum", "n_good", F.explode(ladder).alias("r")).select("stratum", "n_good", "r.*").join(F.broadcast(strata))
    share = risk / len(RULES)
    safe = each.where(binomial_cdf(F.col("n_lost"), F.col("n_good"), share) <= F.lit(error / len(rungs)) / F.col("strata"))
    return safe.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"), F.min_by("n_good", "cutoff").alias("n_good"), F.min_by("n_lost", "cutoff").alias("n_lost"))


def judge(docs: DataFrame, labels: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The counts of each text, ``base_failed``, and ``kept``.

    ``kept`` is false for a text that fails the base or lies above a certified
    cutoff of its stratum.  Texts that are null, empty or blank have no words
    and fail the base.  Repeated rows are judged alike, each on its own.  A
    table without labels certifies nothing, so only the base rejects.
    """
    counted = cut(features(docs, doc_col, text_col, stratum_col))
    chosen = cutoffs(counted, labels, risk=risk, error=error)
    limits = cut(chosen.groupBy("stratum").agg(*(F.min(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"cut_{name}") for name, _, _ in RULES)))
    if limits.count() <= SMALL:
        limits = F.broadcast(limits)
    over = " or ".join(f"coalesce(({feature}) > cut_{name}, false)" for name, feature, _ in RULES)
    return counted.join(limits, "stratum", "left").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~F.expr(over)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", *(f"cut_{name}" for name, _, _ in RULES))
