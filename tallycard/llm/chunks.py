"""Substring deduplication by content-defined chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycard.llm.common import docs_of, query, row_key, settled
from tallycard.llm.shingles import mix

#: Bytes of a chunk: at least, at most, and the bits of the rolling hash that must be zero at a cut (one place in 16).
LEAST, MOST, MASK_BITS = 16, 512, 4
#: Neighbouring repeated chunks are removed when they have so many bytes together: all are, a short last chunk alone as well.
LEAST_RUN = 1
#: Chunks whose marks are the bits of one long, and chunks of an outgoing batch, about.
BLOCK, BATCH_CHUNKS = 64, 100_000
#: One random number per byte value.
GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Rolling hash h = (h << 1) + GEAR[byte] at every place, over the last 64 bytes; six doublings make it."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16, 32):
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint64(step) if step < len(h) else np.empty(0, np.uint64)
        h = longer
    return h


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``. A cut depends on the 64 bytes before it, so cuts fall back in step after a change."""
    n = len(data)
    if not n:
        return []
    top = np.uint64(((1 << MASK_BITS) - 1) << (64 - MASK_BITS))
    cuts = np.flatnonzero((gear_hashes(np.frombuffer(data, np.uint8)) & top) == 0) + 1
    ends, last = [], 0
    for c in cuts.tolist():
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c - last >= LEAST:
            ends.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and digest of every chunk; numbers count from 0 in each text."""
    for batch in batches:
        # the bytes as Spark holds them
        texts, rows, counts, digests, size = batch.column("text").cast(pa.binary()), [], [], [], 0
        for row in range(len(texts)):
            data, start = texts[row].as_py() or b"", 0
            ends = chunk_ends(data)
            for end in ends:
                digests.append(hashlib.blake2b(data[start:end], digest_size=16).digest())
                start = end
            rows.append(row)
            counts.append(len(ends))
            size += len(ends)
            if size > BATCH_CHUNKS:
                yield _chunk_rows(batch, rows, counts, digests)
                rows, counts, digests, size = [], [], [], 0
        yield _chunk_rows(batch, rows, counts, digests)


def _chunk_rows(batch: pa.RecordBatch, rows: list[int], counts: list[int], digests: list[bytes]) -> pa.RecordBatch:
    many = np.array(counts, np.int64)
    at = pa.array(np.repeat(np.array(rows, np.int64), many))
    n = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("key").take(at), pa.array(n), *(pa.array(np.ascontiguousarray(x)) for x in d.T)], names=["id", "key", "n", "d1", "d2"])


def _cleaned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cut again, keep the chunks that are marked as the first of their kind."""
    for batch in batches:
        out = []
        for i, text, blocks, bits in zip(batch["id"], batch["text"], batch["blocks"], batch["bits"]):
            data = _bytes(text)
            ends = chunk_ends(data)
            edges = [0, *ends]
            again = np.ones(-(-len(ends) // BLOCK) * BLOCK, bool)
            if blocks is not None:
                again.reshape(-1, BLOCK)[blocks] = np.unpackbits(np.asarray(bits, "<i8").view(np.uint8), bitorder="little").reshape(-1, BLOCK) == 0
            again = again[:len(ends)]
            turns = np.flatnonzero(np.diff(again, prepend=False, append=False)).tolist()
            spans = [(edges[a], edges[b]) for a, b in zip(turns[::2], turns[1::2]) if edges[b] - edges[a] >= LEAST_RUN]
            kept, at = [], 0
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            rest = b"".join([*kept, data[at:]])
            out.append((i, len(data), len(ends), int(again.sum()), len(spans), len(data) - len(rest), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore"), spans))
        yield pd.DataFrame(out, columns=["id", "n_bytes", "n_chunks", "n_repeated", "n_spans", "n_removed", "kept_sha256", "kept_text", "spans"])


def deduplicate_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove repeated content-defined chunks; one row per row of ``docs`` with what was removed and what stays.

    A chunk stays where it occurs first, by id (null first), then by a key of the content, then by place. Elsewhere it is a repeat
    and is removed, whatever its size; neighbouring repeats are one span. A chunk that repeats within a text goes as well. Repeated rows are one row for this purpose: both keep what the first keeps. A null or empty text has no chunks.
    A kept text that is cut inside a character loses the broken character; the digest is of the bytes.
    """
    # ids travel as text through Python, as null numbers would lose digits on the way
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("key", row_key("id", "text"))
    found = rows.select(F.col("id").cast("string").alias("id"), "key", "text").mapInArrow(_digests, "id string, key long, n long, d1 long, d2 long")
    chunks = found.withColumn("id", F.col("id").cast(id_type))
    # one row per distinct chunk and task goes over the network, so a chunk that every text has is no hot key; texts get back which
    # of their chunks are the first, one row per distinct chunk, and not which are repeats, whose number has no such bound
    first = chunks.groupBy("d1", "d2").agg(F.min(F.struct("id", "key", "n")).alias("first")).select("first.*")
    marks = first.groupBy("id", "key", F.expr(f"n div {BLOCK}").alias("block")).agg(F.expr(f"bit_or(shiftleft(1L, cast(n % {BLOCK} as int)))").alias("bits"))
    texts = settled(marks.groupBy("id", "key").agg(F.collect_list(F.struct("block", "bits")).alias("marks")))
    firsts = texts.select(F.col("id").alias("id2"), F.col("key").alias("key2"), F.col("marks.block").alias("blocks"), F.col("marks.bits").alias("bits"))
    joined = rows.join(firsts, (F.col("key") == F.col("key2")) & F.col("id").eqNullSafe(F.col("id2")), "left").select(F.col("id").cast("string").alias("id"), "text", "blocks", "bits")
    out = joined.mapInPandas(_cleaned, "id string, n_bytes long, n_chunks long, n_repeated long, n_spans long, n_removed long, "
                                       "kept_sha256 string, kept_text string, spans array<struct<start:long,end:long>>")
    return out.withColumn("id", F.col("id").cast(id_type)).withColumnRenamed("id", id_col)


@query("op4_chunks")
def op4_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_chunks(docs_of(spark, sf_dir)).select("doc_id", "n_bytes", "n_chunks", "n_repeated", "n_spans", "n_removed", "kept_sha256")
