"""Resampling towards a target: texts whose word runs are more like a target's are drawn more often."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallycard.llm.common import docs_of, query, settled

#: Lower-cases A-Z; letters, digits and every byte of a non-ASCII character stay, all else becomes a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are split into words at a time; bounds memory only, never a result.
STRETCH = 1 << 20
HASH_RANGE = 2 ** 32


def word_lists(text: bytes, stretch: int = STRETCH) -> Iterator[list[bytes]]:
    """The words of one whole text, in lists of a bounded size."""
    plain, start = text.translate(TABLE), 0
    while start < len(plain):
        end = len(plain) if len(plain) - start <= stretch else plain.find(b" ", start + stretch)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


def bucket_lists(text: bytes, buckets: int, longest: int, stretch: int = STRETCH) -> Iterator[tuple[int, list[int]]]:
    """Number of words, and the buckets of the runs of 1 to ``longest`` words that end among them, for each list of words."""
    before: list[bytes] = []
    for new in word_lists(text, stretch):
        words = before + new
        spaced = [b" " + w for w in words]
        sums = list(map(crc32, words))
        found = [s % buckets for s in sums[len(before):]]
        for k in range(2, longest + 1):
            # a run's sum goes on from that of the run without its last word
            sums = list(map(crc32, spaced[k - 1:], sums))
            found += [s % buckets for s in sums[max(0, len(before) - k + 1):]]
        yield len(new), found
        before = words[len(words) - longest + 1:] if 1 < longest <= len(words) else words if longest > 1 else []


def bucket_counts(texts: DataFrame, text_col: str, buckets: int, longest: int, name: str) -> DataFrame:
    """bucket and the number of runs in it over all rows: one counter per task, added up by Spark."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    for _, found in bucket_lists(text.as_py(), buckets, longest):
                        total.update(found)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["bucket", "n"])

    counted = texts.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias(name))


def bucket_gains(source: DataFrame, target: DataFrame, source_col: str, target_col: str, buckets: int, longest: int) -> list[int]:
    """Log ratio of a bucket's share in the target to that in the source, in thousandths, one added to each count."""
    counts = bucket_counts(source, source_col, buckets, longest, "s").join(bucket_counts(target, target_col, buckets, longest, "t"), "bucket", "full")
    rows = counts.collect()  # at most a row per bucket
    s, t = [0] * buckets, [0] * buckets
    for r in rows:
        s[r["bucket"]], t[r["bucket"]] = r["s"] or 0, r["t"] or 0
    of_source, of_target = float(sum(s) + buckets), float(sum(t) + buckets)
    return [math.floor(1000 * math.log((float(t[b] + 1) * of_source) / (float(s[b] + 1) * of_target))) for b in range(buckets)]


def noise(key: str) -> int:
    """A Gumbel draw in thousandths that depends on the key alone."""
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / HASH_RANGE)))


def with_scores(docs: DataFrame, gains: list[int], id_col: str, text_col: str, longest: int, seed: int) -> DataFrame:
    """id, n_words, n_features, weight, score of every row."""
    # a list of a fixed length, one number per bucket
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            found = []
            for text, key in zip(batch.column("text"), batch.column("key")):
                words = features = total = 0
                if text.is_valid:
                    for n, runs in bucket_lists(text.as_py(), len(gain), longest):
                        words, features = words + n, features + len(runs)
                        total += sum(map(gain.__getitem__, runs))
                weight = total // features if features else 0
                found.append((words, features, weight, weight + noise(key.as_py())))
            columns = zip(*found) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, pa.int64()) for c in columns]], names=["id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"),
                       F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"))
    return rows.mapInArrow(score, f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_features long, weight long, score long")


def drawn(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Adds ``rank`` to the ``percent`` per cent of rows with enough words that have the highest scores.

    Equal rows are counted and numbered together. Scores are whole numbers in a range that the logarithms of counts
    bound (some 10^5 values), so that the rows per score are a small table, whatever the number of rows; the noise
    spreads ids over scores, and only ids of one score are ordered together.
    """
    columns = ["id", "n_words", "n_features", "weight", "score"]
    rows = settled(scored.groupBy(*columns).agg(F.count("*").alias("copies")))
    enough = F.col("n_words") >= least_words
    per_score = rows.filter(enough).groupBy("score").agg(F.sum("copies").alias("n"))
    higher = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    before = settled(per_score.withColumn("before", F.coalesce(F.sum("n").over(higher), F.lit(0))))
    total = before.agg(F.sum("n").alias("n")).first()["n"] or 0
    take = percent * total // 100
    near = rows.filter(enough).join(before.filter(F.col("before") < take).drop("n"), "score")
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("id"), "n_features", "weight", "n_words").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.col("before") + F.sum("copies").over(order)
    ranked = near.withColumn("last", last).select(
        *columns, F.explode(F.sequence(F.col("last") - F.col("copies") + 1, F.col("last"))).alias("rank"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    rest = rows.join(before.filter(F.col("before") < take).select(F.col("score").alias("drawn_score")), (F.col("score") == F.col("drawn_score")) & enough, "left_anti")
    rest = rest.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return ranked.unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             buckets: int = 10_000, longest: int = 2, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """id, n_words, n_features, weight, score and rank of every row of ``docs``; rank is null for rows not drawn.

    A text's features are its runs of 1 to ``longest`` words; its weight is the mean gain of their buckets. Weights plus
    Gumbel noise give a draw without replacement in proportion to the exponential of the weight. The rows of one id
    share their noise. A null or empty text has no features and the weight 0; a null id draws as an empty one and comes
    after all others of its score; repeated rows are drawn one by one, next to each other; empty tables are allowed on
    both sides (no target: gains tell common runs from rare ones only); other columns, whatever their names, are not
    used; very long texts are split into words a stretch at a time.
    """
    gains = bucket_gains(docs, target, text_col, target_col, buckets, longest)
    return drawn(with_scores(docs, gains, id_col, text_col, longest, seed), percent, least_words).withColumnRenamed("id", id_col)


@query("op13_importance_resampling")
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, drawn towards the benchmark's texts."""
    got = resample(docs_of(spark, sf_dir), docs_of(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")
