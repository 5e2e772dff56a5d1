"""Near duplicates by SuperMinHash: signatures, bands, checked links, groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycard.llm.common import docs_of, query, row_key, settled
from tallycard.llm.shingles import digest, mix, shingle_set

BANDS, ROWS = 40, 5
#: A pair at the threshold of 0.8 shares a band with probability 1 - (1 - 0.8^5)^40 = 1 - 1e-7. Its signatures agree in
#: a share of 0.8 with a standard deviation under 0.03, so pairs below this agreement, six deviations off, are not checked.
LEAST_AGREEMENT = 0.62
#: Members of a bucket that are compared in one task; larger buckets are cut in blocks that meet pairwise.
BLOCK = 2000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def superminhash(sets: list[np.ndarray], m: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (one row per set) of m registers.

    Each element runs through a pseudo-random permutation of the registers; its j-th place gets the rank j plus a random
    fraction, and a register keeps its least value. Values of step j are below those of step j + 1, so a set is done as
    soon as a step leaves none of its registers empty. The steps of all sets run together. An empty set has empty registers.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.full((len(sets), m), _EMPTY, dtype=np.uint64)
    flat = out.reshape(-1)
    elements = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = None
    rows = np.arange(len(elements))
    for j in range(m):
        if not len(elements):
            break
        r = mix(elements + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((r & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if order is None:
            place = k
        else:
            place = order[rows, k].astype(np.int64)
            order[rows, k] = order[rows, j]
        value = np.uint64(j << 48) | (mix(r) >> np.uint64(16))
        np.minimum.at(flat, owner * m + place, value)
        open_sets = (out == _EMPTY).any(axis=1) & (sizes > 0)
        stay = open_sets[owner]
        if not stay.all():
            elements, owner, k = elements[stay], owner[stay], k[stay]
            order = order[stay] if order is not None else None
            rows = np.arange(len(elements))
        if order is None and len(elements):
            order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elements), 1))
            order[rows, k] = 0  # the first step's swap
    return out


def _signed(rows: Iterator[pd.DataFrame], k: int, budget: int = 120_000) -> Iterator[pd.DataFrame]:
    """id, key, n, cls, bands, sig of each text; about ``budget`` elements are worked on at once."""
    names = ["id", "key", "n", "cls", "bands", "sig"]
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))

    def flush(held):
        sig = superminhash([s for _, _, s in held])
        bands = np.tile(salt, (len(held), 1))
        cut = sig.reshape(len(held), BANDS, ROWS)
        for r in range(ROWS):
            bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, r])
        small = (mix(sig) & np.uint64(255)).astype(np.uint8)
        bands = bands.view(np.int64)
        return pd.DataFrame([
            (i, key, len(s), digest(s) if len(s) else None, bands[n] if len(s) else None, small[n].tobytes() if len(s) else None)
            for n, (i, key, s) in enumerate(held)], columns=names).astype({"cls": "Int64"})

    for batch in rows:
        held, size = [], 0
        for i, key, text in zip(batch["id"], batch["key"], batch["text"]):
            held.append((i, key, shingle_set(text, k)))
            size += len(held[-1][2]) + 1
            if size >= budget:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)


def components(links: DataFrame) -> DataFrame:
    """node and comp (the least node it is connected with) for every node of ``links`` (a, b).

    In each round every node joins its least neighbour, labels follow, and the links are drawn between the labels; the
    nodes are hashes, so chains of ascending nodes are short and the number of links falls steeply.
    """
    links = settled(links.select("a", "b"))
    labels = settled(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node")))
    while links.take(1):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = settled(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("old"), F.least("a", "b").alias("new")))
        labels = settled(labels.join(up, labels["comp"] == up["old"], "left").select("node", F.coalesce("new", "comp").alias("comp")))
        left, right = up.toDF("a", "ca"), up.toDF("b", "cb")
        links = settled(links.join(left, "a").join(right, "b").filter("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    return labels


def _agreeing(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for r in rows:
        if len(r):
            a = np.frombuffer(b"".join(r["sa"]), np.uint8).reshape(len(r), -1)
            b = np.frombuffer(b"".join(r["sb"]), np.uint8).reshape(len(r), -1)
            yield r.loc[(a == b).mean(axis=1) >= LEAST_AGREEMENT, ["a", "b"]]


def _linked(percent: int):
    def check(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in rows:
            hit = []
            for x, y in zip(r["xa"], r["xb"]):
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                hit.append(100 * both >= percent * ((len(x) + len(y)) // 8 - both))
            yield r.loc[np.array(hit, dtype=bool), ["a", "b"]]

    return check


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    sig = sets.select("cls", "sig")
    likely = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").mapInPandas(_agreeing, "a long, b long")
    full = sets.select("cls", "elements")
    return likely.join(full.toDF("a", "xa"), "a").join(full.toDF("b", "xb"), "b").mapInPandas(_linked(percent), "a long, b long")


def _likely(rows: pd.DataFrame, pairs_at_once: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places x, y and agreement of likely pairs between groups, for whole blocks in ``rows``.

    A pair that shares several buckets counts in the first of them only: as its groups differ, all of them are open.
    """
    sig = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(len(rows), -1)
    bands = np.stack(rows["bands"].to_list())
    bucket, comp, side = (rows[c].to_numpy() for c in ("bucket", "comp", "side"))
    block = rows["i"].to_numpy().astype(np.int64) << 32 | rows["j"].to_numpy()
    first = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])]))
    sizes = np.diff(np.append(first, len(rows)))
    # every row with every later one of its block
    later = np.repeat(first + sizes, sizes) - np.arange(len(rows)) - 1
    upto, at = np.cumsum(later), 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + pairs_at_once)))
        count = later[at:end]
        x = np.repeat(np.arange(at, at + len(count)), count)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)
        at = end
        other = (comp[x] != comp[y]) & ((side[x] == 0) | (side[x] != side[y]))
        x, y = x[other], y[other]
        agree = (sig[x] == sig[y]).mean(axis=1)
        x, y, agree = (v[agree >= LEAST_AGREEMENT] for v in (x, y, agree))
        common = np.where(bands[x] == bands[y], bands[x], np.iinfo(np.int64).max)
        here = common.min(axis=1, initial=np.iinfo(np.int64).max) == bucket[x]
        yield x[here], y[here], agree[here]


def _whole_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole blocks of a sorted partition; one that goes on in the next batch waits for it."""
    waiting = None
    for batch in batches:
        rows = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
        tail = rows[["bucket", "i", "j"]].iloc[-1]
        cut = int(((rows["bucket"] == tail["bucket"]) & (rows["i"] == tail["i"]) & (rows["j"] == tail["j"])).to_numpy().argmax())
        waiting = rows.iloc[cut:].reset_index(drop=True)
        if cut:
            yield rows.iloc[:cut]
    if waiting is not None and len(waiting):
        yield waiting


def _meeting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows that have a likely partner of another group in their block."""
    for rows in _whole_blocks(batches):
        own = np.zeros(len(rows), bool)
        for x, y, _ in _likely(rows):
            own[x] = own[y] = True
        yield rows.loc[own, ["bucket", "i", "j", "cls", "comp", "side"]]


def _spanning(percent: int):
    """Checks likely pairs on full sets, the likeliest first, unless their groups are joined by then; gives the links that join groups."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_blocks(batches):
            found = [np.concatenate(v) for v in zip(*_likely(rows))]
            if not found:
                continue
            x, y, agree = found
            order = np.argsort(-agree, kind="stable")
            cls, comp, parent, links = rows["cls"].to_numpy(), rows["comp"].to_numpy(), {}, []
            elements = [np.frombuffer(e, np.uint64) for e in rows["elements"]]

            def root(c: int) -> int:
                while parent.get(c, c) != c:
                    parent[c] = parent.get(parent[c], parent[c])
                    c = parent[c]
                return c

            for p, q in zip(x[order].tolist(), y[order].tolist()):
                a, b = root(comp[p]), root(comp[q])
                small, large = sorted((len(elements[p]), len(elements[q])))
                if a == b or 100 * small < percent * large:
                    continue
                both = len(np.intersect1d(elements[p], elements[q], assume_unique=True))
                if 100 * both >= percent * (small + large - both):
                    parent[max(a, b)] = min(a, b)
                    links.append((min(cls[p], cls[q]), max(cls[p], cls[q])))
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their present group, of the buckets that still hold several groups."""
    now = members.join(labels, members["cls"] == labels["node"], "left").select("bucket", "cls", F.coalesce("comp", "cls").alias("comp"))
    several = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).filter("lo != hi").select("bucket", "size")
    return settled(now.join(settled(several), "bucket"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, ``content_key``, ``n_shingles``, ``component_id`` and ``kept``.

    Texts are linked when 100 * common shingles >= ``percent`` * all shingles of both. Equal sets are one class from the
    start, and only classes are compared, so copies never meet as pairs. Classes that share a band are candidates. Each
    class is first checked against one leader of its buckets, twice with different leaders; buckets that then hold one
    connected group are done. In the others all likely pairs between groups are checked on the full sets inside the task
    that holds their bucket, the likeliest first, unless other links have joined their groups by then. What leaves a task
    are links that join groups, fewer than its classes, and no link that could change a group is left out.

    ``component_id`` is the least id that can be reached, the row's own included; ``kept`` marks the rows that have it.
    Rows without words are linked with nothing. A null id is never the least; a group of null ids has a null
    ``component_id`` and keeps them. Repeated rows share a class.
    """
    spark = docs.sparkSession
    # ids travel as text through Python, as null numbers would lose digits on the way
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))
    signed = rows.mapInPandas(lambda batches: _signed(batches, k), "id string, key long, n long, cls long, bands array<long>, sig binary")
    signed = settled(signed.withColumn("id", F.col("id").cast(id_type)))
    worded = signed.filter("cls is not null")
    in_bands = worded.select("cls", F.explode("bands").alias("bucket"))
    shared = settled(in_bands.groupBy("bucket").agg(F.min("cls").alias("leader"), F.max("cls").alias("hi")).filter("leader != hi").select("bucket", "leader"))
    # tables that grow with the corpus are joined by sorting at every size; a small one would else be broadcast
    members = settled(in_bands.join(shared.hint("merge"), "bucket").distinct())

    # the full sets, of candidate classes only, each made from one of its texts
    wanted = members.select("cls").distinct()
    one = worded.select("cls", "key", "id").join(wanted.hint("merge"), "cls", "left_semi").groupBy("cls").agg(F.min(F.struct("key", "id")).alias("of")).select("cls", "of.key", "of.id")
    one = settled(one)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"cls": batch["cls"], "elements": [shingle_set(t, k).tobytes() for t in batch["text"]]})

    texts = rows.join(one.select("cls", F.col("key").alias("key1"), F.col("id").cast("string").alias("id1")).hint("merge"), (F.col("key") == F.col("key1")) & F.col("id").eqNullSafe(F.col("id1")))
    filled = texts.select("cls", "text").mapInPandas(fill, "cls long, elements binary")
    sigs = worded.join(one.select("cls", "key", F.struct("id").alias("w")).withColumnRenamed("cls", "c2").withColumnRenamed("key", "k2").hint("merge"), (F.col("cls") == F.col("c2")) & (F.col("key") == F.col("k2"))).select("cls", "sig", "bands")
    sets = settled(filled.dropDuplicates(["cls"]).join(sigs.dropDuplicates(["cls"]), "cls"))

    empty = spark.createDataFrame([], "a long, b long")
    links = settled(empty)
    labels = spark.createDataFrame([], "node long, comp long")
    open_rows = None
    # one leader per class and round
    first = members.filter("cls != leader").groupBy("cls").agg(F.min("leader").alias("a")).select("a", F.col("cls").alias("b"))
    for step in range(2):
        if step:
            order = F.xxhash64("cls", F.lit(step))
            leaders = open_rows.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), F.col("cls").alias("leader"), F.col("comp").alias("lc"))).alias("x")).select("bucket", "x.*")
            met = open_rows.join(leaders, "bucket").filter("comp != lc")
            first = met.groupBy("cls").agg(F.min(F.struct("o", "leader")).alias("x")).select(F.col("x.leader").alias("a"), F.col("cls").alias("b"))
        new = settled(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        links = settled(links.unionByName(_verified(new, sets, percent)))
        labels = components(links)
        open_rows = _open_buckets(members, labels)
        if not open_rows.take(1):
            break
    if open_rows.take(1):
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("cls", F.lit("block")), blocks).cast("int")
        cut = open_rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
            "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls", "comp",
            F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
        in_order = lambda df: df.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        # full sets go only where a likely partner is
        meet = settled(in_order(cut.join(sets.select("cls", "sig", "bands"), "cls")).mapInPandas(_meeting, "bucket long, i int, j int, cls long, comp long, side int"))
        added = settled(in_order(meet.join(sets, "cls")).mapInPandas(_spanning(percent), "a long, b long"))
        labels = components(links.unionByName(added))

    ids = worded.select("id", "cls").join(labels, F.col("cls") == F.col("node"), "left").select("id", F.coalesce("comp", "cls").alias("comp"))
    least = settled(ids.groupBy("comp").agg(F.min("id").alias("component_id"), F.count("*").alias("rows")).filter("rows > 1").select("comp", "component_id"))
    known = worded.select("id", "key", "n", "cls").join(labels, F.col("cls") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "cls"))
    # groups of one have no row in ``least``
    grouped = known.join(least.withColumn("found", F.lit(True)), "comp", "left").select(
        "id", "key", "n", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    bare = signed.filter("cls is null").select("id", "key", "n", F.col("id").alias("component_id"))
    out = grouped.unionByName(bare)
    return out.select(F.col("id").alias(id_col), F.col("key").alias("content_key"), F.col("n").alias("n_shingles"), "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, all columns as they are."""
    gone = near_duplicates(docs, id_col, text_col, k, percent).filter(~F.col("kept"))
    gone = settled(gone.select(F.col(id_col).alias("bad_id"), F.col("content_key").alias("bad_key")).distinct())
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"))
    return rows.join(gone, rows["id"].eqNullSafe(gone["bad_id"]) & (rows["key"] == gone["bad_key"]), "left_anti").select("row.*")


@query("op8_superminhash")
def op8_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(docs_of(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")
