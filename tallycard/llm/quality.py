"""Quality rules: simple rules on words and lines, then robust multivariate outliers per language and source.

Everything here is DataFrame expressions. The texts are read once; the estimates work on a narrow table of statistics.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycard.llm.common import docs_of, fresh, let, query, row_key, same, settled, words_of

WINDOW = 5
#: The transformed statistics and, for each, the least standard deviation that an estimate may have. Most clean texts
#: have a rate of exactly zero, and a scale of zero would make every other text an outlier.
STATISTICS = {"word_length": 0.12, "symbols": 0.05, "capitals": 0.08, "dup_lines": 0.12, "repeats": 0.06}
#: Words of an average text that are added to each text, so that the rates of short texts vary less.
PRIOR_WORDS, PRIOR_LENGTH = 30, 5.5
#: Steps of the logarithmic distance scale on which the nearest rows are counted.
STEPS = 12


def chi2_below(x: float, k: int) -> float:
    """Distribution function of chi-squared with k degrees of freedom."""
    if x <= 0:
        return 0.0
    a, y = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= y / n
        total += term
    return min(1.0, total * math.exp(-y + a * math.log(y) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(mid, k) < p else (low, mid)
    return high


def _n_repeat_words(words: Column) -> Column:
    """Words that lie in a window of five words which the text has twice or more."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(
        F.when(F.size(h) >= WINDOW, F.sequence(F.lit(0), F.size(h) - WINDOW)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))

    def covered(starts: Column) -> Column:
        reach = F.transform(starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda a, r: a + r)

    def repeated(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda p, k: (
            F.coalesce(F.get(pairs, k + 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.when(k > 0, F.get(pairs, F.greatest(k - 1, F.lit(0)))["h"] == p["h"]), F.lit(False))))
        return let(F.sort_array(F.transform(twice, lambda p: p["i"])), covered)

    def count(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(ordered, repeated))

    return let(windows, count)


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` that do not clash, with the counts of each whole text; a null text has none."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_lines"]
    text = fresh(docs, "whole_text")
    words, lines = fresh(docs, "word_list"), fresh(docs, "line_list")
    kept = [c for c in docs.columns if c not in counts]
    rows = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))).select(*kept, text)
    rows = rows.withColumns({words: words_of(F.col(text)), lines: F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    return rows.select(
        *kept,
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _n_repeat_words(F.col(words)).alias("n_repeat_words"),
        F.regexp_count(text, F.lit("[A-Z][A-Z]")).cast("long").alias("n_capitals"),
        F.size(lines).cast("long").alias("n_lines"),
    )


def _vector() -> dict[str, Column]:
    """Transformed statistics, all near zero to a few units."""
    n = F.col("n_words") + PRIOR_WORDS
    return {
        "word_length": F.log((F.col("word_chars") + PRIOR_WORDS * PRIOR_LENGTH) / n),
        "symbols": F.log1p(F.col("n_symbols") / n),
        "capitals": F.log1p(F.col("n_capitals") / n),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 5)),
        "repeats": F.col("n_repeat_words") / n,
    }


NAMES = list(STATISTICS)
PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]


def _estimates(rows: DataFrame, least: Column, scale: float) -> DataFrame:
    """Mean and Cholesky factor of the covariance of each (grp, start)'s rows with the smallest buckets.

    ``rows`` has grp, start, bucket and the statistics. Sums are taken per bucket, so no group is ever gathered: what a
    window orders is the buckets of a group, whose number the distance scale bounds. Whole buckets are taken until they
    hold ``least`` rows, an expression over n.
    """
    sums = [F.count("*").alias("c"), *[F.sum(x).alias(f"s_{x}") for x in NAMES],
            *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"q_{i}_{j}") for i, j in PAIRS]]
    by_bucket = rows.groupBy("grp", "start", "bucket").agg(*sums)
    moments = ["c", *[f"s_{x}" for x in NAMES], *[f"q_{i}_{j}" for i, j in PAIRS]]
    from pyspark.sql import Window

    group = Window.partitionBy("grp", "start")
    so_far = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    run = by_bucket.select("grp", "start", F.sum("c").over(group).alias("n"), F.col("c").alias("own"), *[F.sum(m).over(so_far).alias(m) for m in moments])
    # the first bucket with which enough rows are there
    at_least = F.least(F.col("n"), F.greatest(least, F.lit(1)))
    chosen = run.filter((F.col("c") >= at_least) & (F.col("c") - F.col("own") < at_least))
    out = chosen.select("grp", "start", F.col("n"), F.col("c").alias("taken"), *[(F.col(f"s_{x}") / F.col("c")).alias(f"m_{x}") for x in NAMES], *[f"q_{i}_{j}" for i, j in PAIRS])
    floors = list(STATISTICS.values())
    out = out.select("grp", "start", "n", "taken", *[f"m_{x}" for x in NAMES], *[
        ((F.col(f"q_{i}_{j}") / F.col("taken") - F.col(f"m_{NAMES[i]}") * F.col(f"m_{NAMES[j]}")) * scale + (floors[i] ** 2 if i == j else 0.0)).alias(f"v_{i}_{j}") for i, j in PAIRS])
    for j in range(len(NAMES)):
        rest = F.col(f"v_{j}_{j}")
        for k in range(j):
            rest = rest - F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}")
        out = out.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))))
        below = {}
        for i in range(j + 1, len(NAMES)):
            rest = F.col(f"v_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            below[f"l_{i}_{j}"] = rest / F.col(f"l_{j}_{j}")
        if below:
            out = out.withColumns(below)
    # settled: the next pass joins a table of known size, broadcast when small; else Spark can split a hot group
    return settled(out.select("grp", "start", "n", "taken", *[f"m_{x}" for x in NAMES], *[f"l_{i}_{j}" for i, j in PAIRS]))


def _distances(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance ``d2`` of each row to its group's estimates, by forward substitution."""
    joined = rows.join(estimates, "grp")
    for i, x in enumerate(NAMES):
        rest = F.col(x) - F.col(f"m_{x}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        joined = joined.withColumn(f"z_{i}", rest / F.col(f"l_{i}_{i}"))
    d2 = F.lit(0.0)
    for i in range(len(NAMES)):
        d2 = d2 + F.col(f"z_{i}") * F.col(f"z_{i}")
    return joined.withColumn("d2", d2)


def _bucket(d2: Column) -> Column:
    return F.floor(F.log(d2 + 1e-6) * STEPS).cast("int")


def robust_distances(rows: DataFrame, keep: list[str], alpha: float = 0.75, starts: int = 3, rounds: int = 4) -> DataFrame:
    """Add ``d2``, the squared robust distance of each row within its ``grp``.

    Minimum covariance determinant by concentration: from the whole group and from ``starts`` - 1 small pseudo-random
    subsets, the share ``alpha`` of rows nearest to the current estimate gives the next one, ``rounds`` times; the
    estimate with the smallest determinant stays. Rows within the 97.5 % point then give the final estimate. A group's
    nearest rows are found by counting distances on a fine logarithmic scale, with whole steps taken. Estimates include
    the scale floors of STATISTICS, so groups of one row or of equal rows have a result (distance 0).
    """
    k = len(NAMES)
    cut = chi2_quantile(alpha, k)
    scale = alpha / chi2_below(cut, k + 2)  # makes the covariance of the nearest rows that of all, for normal data
    u = (F.xxhash64("tie", F.col("start")).bitwiseAND(F.lit((1 << 53) - 1)) + 1) / float(1 << 53)
    first = rows.select("grp", "tie", *NAMES, F.explode(F.array(*[F.lit(s) for s in range(starts)])).alias("start"))
    first = first.withColumn("bucket", F.when(F.col("start") == 0, F.lit(0)).otherwise(F.floor(F.log(u) * STEPS).cast("int")))
    # the whole group for start 0, some thirty rows for the others
    current = _estimates(first, F.when(F.col("start") == 0, F.col("n")).otherwise(F.lit(6 * (k + 1))), 1.0)
    for _ in range(rounds):
        near = _distances(rows.select("grp", *NAMES), current)
        current = _estimates(near.select("grp", "start", _bucket(F.col("d2")).alias("bucket"), *NAMES), F.ceil(F.col("n") * alpha), scale)
    volume = F.lit(0.0)
    for i in range(k):
        volume = volume + F.log(F.col(f"l_{i}_{i}"))
    best = current.groupBy("grp").agg(F.min_by(F.struct(*current.columns), F.struct(volume.alias("v"), F.col("start").alias("s"))).alias("b")).select("b.*")
    near = _distances(rows.select("grp", *NAMES), settled(best))
    inner = near.withColumn("bucket", F.when(F.col("d2") <= chi2_quantile(0.975, k), 0).otherwise(1))
    final = _estimates(inner.select("grp", "start", "bucket", *NAMES), F.lit(1), 1.0)
    return _distances(rows.select("grp", *keep, *NAMES), final).select(*keep, "d2")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                  least_words: int = 10, most_repeats: int = 20, tail: float = 1e-5) -> DataFrame:
    """One row per row of ``docs``: id, a content key, the counts, ``base_failed``, ``distance`` and ``kept``.

    A text fails the base rules with fewer than ``least_words`` words or with over ``most_repeats`` per cent of its
    words in repeated windows. Those that pass are estimated per language and source (null is a value of its own) and
    kept up to the distance that a normal vector exceeds with probability ``tail``. A null text has no words and fails.
    Repeated rows are judged alike. An empty table gives an empty result. Other columns of ``docs`` are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    rows = rows.withColumn("tie", row_key("id", "text", "lang", "source")).withColumn("grp", F.to_json(F.struct("lang", "source")))
    counted = text_counts(rows).drop("text", "lang", "source")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    table = settled(counted.withColumn("base_failed", failed).withColumns(_vector()))
    counts = ["id", "tie", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    passed = robust_distances(table.filter(~F.col("base_failed")), [*counts, "base_failed"])
    out = passed.withColumn("kept", F.col("d2") <= chi2_quantile(1 - tail, len(NAMES))).unionByName(
        table.filter("base_failed").select(*counts, "base_failed", F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept")))
    return out.select(F.col("id").alias(id_col), F.col("tie").alias("content_key"), *counts[2:], "base_failed", F.sqrt("d2").alias("distance"), "kept")


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the quality rules keep, with all their columns as they are."""
    bad = quality_rules(docs, id_col, text_col, lang_col, source_col).filter(~F.col("kept"))
    bad = settled(bad.select(F.col(id_col).alias("bad_id"), F.col("content_key").alias("bad_key")).distinct())
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), row_key(id_col, text_col, lang_col, source_col).alias("key"))
    hit = rows["id"].eqNullSafe(bad["bad_id"]) & (rows["key"] == bad["bad_key"])
    return rows.join(bad, hit, "left_anti").select("row.*")


@query("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(docs_of(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
