"""Exact substring deduplication: every byte that a repeated string of a given length covers.

Strings are compared by suffix arrays, of shards. Each place of a text belongs to an anchor: the 80 bytes with the
least hash among those in the string of 200 bytes that starts there. Equal strings have equal anchors, so a shard that
gets all regions of an anchor sees all that its strings can be equal to. Regions are sent only for anchors that occur
more than once, and equal regions only once, with their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycard.llm.common import docs_of, query, row_key, settled
from tallycard.llm.shingles import mix
from tallycard.llm.suffix_array import permuted_prefixes, suffix_array

LENGTH, ANCHOR = 200, 80
#: Bytes of regions in one shard, about. An anchor with more distinct regions than this is too large for one shard: each
#: of its strings is then counted by itself, spread over all tasks.
SHARD_BYTES, MOST_REGIONS = 400_000, 1500
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_POWERS: list[np.ndarray] = []


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 17)
        both = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE)]
        _POWERS[:] = both
    return _POWERS[0][:n], _POWERS[1][:n]


def anchored_regions(data: bytes, length: int = LENGTH, anchor: int = ANCHOR):
    """Runs of string starts with the same anchor: anchor hashes, region hashes, first starts, numbers of starts."""
    n = len(data)
    if n < length:
        return None
    up, down = _powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_SYMBOL[np.frombuffer(data, np.uint8)] * up[:n])])
    hashes = mix((sums[anchor:] - sums[:-anchor]) * down[: n - anchor + 1])
    width = length - anchor + 1  # anchors in a string
    best = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    if width > step:
        best = np.minimum(best[: len(best) - (width - step)], best[width - step:])
    at = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(first, len(at)))
    end = first + count - 1 + length
    region = mix((sums[end] - sums[first]) * down[first] + count.astype(np.uint64))
    return mix(hashes[at[first]] + np.uint64(1)).view(np.int64), region.view(np.int64), first, count


def _anchors(length: int):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, parts, size = [], [], 0
            for n, text in enumerate(batch["text"]):
                found = anchored_regions(_bytes(text), length)
                if found is not None:
                    parts.append(found)
                    rows.append(np.full(len(found[0]), n))
                    size += len(found[0])
                if size > 200_000:
                    yield _table(batch, rows, parts)
                    rows, parts, size = [], [], 0
            if parts:
                yield _table(batch, rows, parts)

    def _table(batch, rows, parts):
        own = np.concatenate(rows)
        cols = [np.concatenate(x) for x in zip(*parts)]
        return pd.DataFrame({"k1": batch["k1"].to_numpy()[own], "k2": batch["k2"].to_numpy()[own], "anchor": cols[0], "region": cols[1],
                             "start": cols[2].astype(np.int32), "n": cols[3].astype(np.int32)})

    return find


def _cut_regions(length: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, wanted in zip(batch["text"], batch["wanted"]):
                data = _bytes(text)
                out += [(w["anchor"], w["region"], w["n"], data[w["start"]: w["start"] + w["n"] - 1 + length]) for w in wanted]
            yield pd.DataFrame(out, columns=["anchor", "region", "n", "bytes"])

    return cut


def repeated_starts(regions: list[bytes], length: int) -> list[np.ndarray]:
    """For each region, which of its strings of ``length`` bytes also starts elsewhere in the regions."""
    sizes = np.array([len(r) for r in regions])
    # the symbol 0 ends each region, bytes are 1 to 256
    flat = np.zeros(int(sizes.sum()) + len(regions), np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    for o, r in zip(offsets, regions):
        flat[o: o + len(r)] = np.frombuffer(r, np.uint8).astype(np.int64) + 1
    sa = suffix_array(flat)
    prefix = permuted_prefixes(flat, sa)
    # the neighbour behind has this prefix with its own predecessor
    behind = np.zeros(len(flat), np.int64)
    behind[sa[:-1]] = prefix[sa[1:]]
    repeated = np.maximum(prefix, behind) >= length
    return [repeated[o: o + s - length + 1] for o, s in zip(offsets, sizes)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]


def _shard(length: int):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["anchor", "region", "n"], kind="stable")
        flags = repeated_starts(list(rows["bytes"]), length)
        return pd.DataFrame({"anchor": rows["anchor"], "region": rows["region"], "n": rows["n"], "runs": [_runs(f) for f in flags]})

    return compare


def _strings(length: int):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for anchor, region, n, data in zip(batch["anchor"], batch["region"], batch["n"], batch["bytes"]):
                for k in range(n):
                    d = hashlib.blake2b(data[k: k + length], digest_size=16).digest()
                    out.append((anchor, region, n, k, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
            yield pd.DataFrame(out, columns=["anchor", "region", "n", "k", "d1", "d2"])

    return each


def _removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for i, text, found in zip(batch["id"], batch["text"], batch["found"]):
            data, spans = _bytes(text), []
            for a, b in sorted((x["a"], x["b"]) for x in found) if found is not None else ():
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            at, kept = 0, []
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            rest = b"".join([*kept, data[at:]])
            out.append((i, len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), [tuple(s) for s in spans], rest))
        yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Remove each byte of a text that a string of ``length`` bytes covers which also starts anywhere else.

    One row per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, the removed ``spans`` and
    the ``kept`` bytes. Elsewhere is any other place of any text, the same one included; both lose the string. Strings
    are judged on the texts as they come in and do not cross texts. A null text is empty; texts shorter than ``length``
    stay whole. A row that is there twice repeats itself. An empty table gives an empty result.
    """
    key = ["anchor", "region", "n"]
    # rows are known by two hashes of their content; ids travel as text, as null numbers would lose digits on the way
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumns({"k1": row_key("id", "text"), "k2": row_key("text", "id", F.lit(1))})
    places = settled(rows.select("k1", "k2", "text").mapInPandas(_anchors(length), "k1 long, k2 long, anchor long, region long, start int, n int"))
    several = settled(places.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor"))
    places = settled(places.join(several, "anchor", "left_semi"))

    # one row per distinct region, with one place where it is found
    regions = settled(places.groupBy(*key).agg(F.count("*").alias("copies"), F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first("start").alias("start")))
    of_anchor = settled(regions.groupBy("anchor").agg(F.count("*").alias("regions")).filter("regions > 1"))
    compared = regions.join(of_anchor, "anchor")
    wanted = compared.groupBy("k1", "k2").agg(F.collect_list(F.struct(*key, "start")).alias("wanted"))
    cut = rows.join(wanted, ["k1", "k2"]).select("text", "wanted").mapInPandas(_cut_regions(length), "anchor long, region long, n int, bytes binary")
    cut = settled(cut.join(of_anchor, "anchor").dropDuplicates(key))
    volume = cut.filter(F.col("regions") <= MOST_REGIONS).agg(F.sum(F.length("bytes")).alias("b")).first()["b"] or 0
    shards = max(1, -(-volume // SHARD_BYTES))
    in_shards = cut.filter(F.col("regions") <= MOST_REGIONS).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    runs = "array<struct<a:int,b:int>>"
    by_array = in_shards.select("shard", *key, "bytes").groupBy("shard").applyInPandas(_shard(length), f"anchor long, region long, n int, runs {runs}")
    strings = cut.filter(F.col("regions") > MOST_REGIONS).select(*key, "bytes").mapInPandas(_strings(length), "anchor long, region long, n int, k int, d1 long, d2 long")
    often = strings.groupBy("d1", "d2").agg(F.count("*").alias("c")).filter("c > 1").select("d1", "d2")
    by_string = strings.join(often, ["d1", "d2"]).groupBy(*key).agg(F.collect_set(F.struct(F.col("k").alias("a"), (F.col("k") + 1).alias("b"))).alias("runs"))
    # a region that is there twice is repeated as a whole
    whole = regions.filter("copies > 1").select(*key, F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).cast(runs).alias("runs"))
    single = regions.filter("copies = 1").select(*key)
    partly = by_array.unionByName(by_string).filter(F.size("runs") > 0).join(single, key, "left_semi")
    repeated = settled(whole.unionByName(partly))

    found = places.join(repeated, key).select("k1", "k2", F.explode(F.transform("runs", lambda r: F.struct(
        (F.col("start") + r["a"]).alias("a"), (F.col("start") + r["b"] - 1 + length).alias("b")))).alias("x"))
    found = found.groupBy("k1", "k2").agg(F.collect_set("x").alias("found"))
    out = rows.join(found, ["k1", "k2"], "left").select("id", "text", "found").mapInPandas(
        _removed, "id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:long,b:long>>, kept binary")
    return out.withColumn("id", F.col("id").cast(id_type)).withColumnRenamed("id", id_col)


@query("op2_suffix_repeats")
def op2_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(docs_of(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
