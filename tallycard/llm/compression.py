"""Quality from compression: which of two zstandard dictionaries makes a text smaller."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycard.llm.common import docs_of, query, settled

#: Labelled rows that are looked at, at most about so many, chosen by a hash of the id; longer texts are not among them.
MAX_TRAINING, LONGEST_TRAINING = 20_000, 200_000
#: Characters of text that one dictionary is built from, at most about so many, chosen by a hash of the id.
MAX_DICTIONARY_TEXT = 8_000_000
DICTIONARY_BYTES, LEVEL = 112_640, 3
#: A text is compressed in blocks, so that the dictionary matters as much at the end of a long text as at its start.
BLOCK = 1024
#: Added to the length before dividing: a very short text tells little.
PRIOR_BYTES = 50


def _remainder(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))


def build_dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> tuple[bytes, bool]:
    """A dictionary for texts like these, and whether it was trained; too few texts to train on are taken as they are."""
    blocks = [t[i:i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(size, blocks, k=200, d=8, level=LEVEL).as_bytes(), True
    except zstandard.ZstdError:
        return b"".join(blocks)[-size:], False


def compressor(content: bytes, trained: bool) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    made = zstandard.ZstdCompressionDict(content, dict_type=kind)
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_dict_id=False)


def size_difference(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """Bytes that the good dictionary saves over the bad one, per byte of the whole text; 0 for an empty one."""
    saved = 0
    for i in range(0, len(text), BLOCK):
        block = text[i:i + BLOCK]
        saved += len(bad.compress(block)) - len(good.compress(block))
    return saved / (len(text) + PRIOR_BYTES)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """id, text, label of a bounded sample of the labelled rows that are not held out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).filter("id is not null and label in (0, 1)")
    known = known.filter(_remainder("id") != 2).dropDuplicates(["id"])
    share = min(1.0, most / max(known.count(), 1))
    known = settled(known.filter(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1_000_000)) < math.ceil(share * 1_000_000)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).filter(F.length(F.col(text_col)) <= LONGEST_TRAINING)
    return texts.join(known, "id").select(F.col("id").cast("string").alias("id"), "text", "label")


def dictionaries(rows: DataFrame, chars: dict[float, int]) -> dict[float, tuple[bytes, bool]]:
    """A dictionary per label; the rows are thinned by a hash to the text that a dictionary may be built from."""
    def build(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        content, trained = build_dictionary(list(own.sort_values("id")["text"]))
        return pd.DataFrame({"label": [key[0]], "content": [content], "trained": [trained]})

    share = F.create_map(*[F.lit(x) for y, n in chars.items() for x in (y, min(1.0, MAX_DICTIONARY_TEXT / max(n, 1)))])[F.col("label")]
    some = rows.filter(F.pmod(F.xxhash64("id", F.lit("dictionary")), F.lit(1_000_000)) < F.ceil(share * 1_000_000))
    made = some.groupBy("label").applyInPandas(build, "label double, content binary, trained boolean")
    return {r["label"]: (bytes(r["content"]), r["trained"]) for r in made.collect()}  # two rows of a fixed size


def with_difference(rows: DataFrame, good: tuple[bytes, bool], bad: tuple[bytes, bool]) -> DataFrame:
    """``rows`` with the column ``difference`` in place of ``text``."""
    keep = [c for c in rows.columns if c != "text"]
    shared = rows.sparkSession.sparkContext.broadcast((good, bad))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_good, with_bad = (compressor(*d) for d in shared.value)
        for batch in batches:
            found = [size_difference(t.as_buffer().to_pybytes() if t.is_valid else b"", with_good, with_bad) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found, pa.float64())], names=[*keep, "difference"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(measure, ", ".join([f"`{c}` {types[c]}" for c in keep] + ["difference double"]))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  most: int = MAX_TRAINING, at_least: float = 0.7) -> DataFrame:
    """id, ``held_out``, ``difference``, ``score`` and ``predicted`` of every row of ``docs``.

    Two dictionaries are built from about three fifths of the training rows, one per label. The difference of the sizes
    that a whole text has with them, per byte, goes through an isotonic curve fitted on the other training rows. A small
    share of the score follows the difference itself, so that rows on one step of the curve are still ordered. Without
    labels of both kinds every score is the share of positive labels, 0 without any, and the difference null. A null or
    empty text has the difference 0, like one that both dictionaries serve alike; a null id is not held out; repeated
    rows score alike; an empty table gives an empty one; other columns of ``docs``, whatever their names, are not used;
    very long texts cost time in proportion to their length, and the memory of one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = [F.col("id").alias(id_col), F.coalesce(_remainder("id") == 2, F.lit(False)).alias("held_out")]
    sample = settled(training_rows(docs, labels, id_col, text_col, label_col, most))
    fold = F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(5)) < 2
    sizes = {(r["fold"], r["label"]): (r["n"], r["chars"]) for r in sample.groupBy(fold.alias("fold"), "label").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()}
    if not all(sizes.get((f, y), (0, 0))[1] for f in (True, False) for y in (0.0, 1.0)):
        share = sum(n for (_, y), (n, _) in sizes.items() if y) / max(sum(n for n, _ in sizes.values()), 1)
        return rows.select(*out, F.lit(None).cast("double").alias("difference"), F.lit(float(share)).alias("score"), F.lit(int(share >= at_least)).alias("predicted"))
    made = dictionaries(sample.filter(~fold), {y: sizes[(False, y)][1] for y in (0.0, 1.0)})
    seen = settled(with_difference(sample.filter(fold), made[1.0], made[0.0]).select("difference", "label"))
    curve = IsotonicRegression(featuresCol="difference", labelCol="label", predictionCol="calibrated").fit(seen)
    scored = curve.transform(with_difference(rows, made[1.0], made[0.0]))
    score = 0.998 * F.col("calibrated") + 0.002 / (1 + F.exp(-20 * F.col("difference")))
    scored = scored.withColumn("score", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))
    return scored.select(*out, "difference", "score", F.when(F.col("score") >= at_least, 1).otherwise(0).alias("predicted"))


@query("op11_compression_quality")
def op11_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(docs_of(spark, sf_dir), docs_of(spark, sf_dir, "labels"))
