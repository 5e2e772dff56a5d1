"""Benchmark decontamination by latent semantic retrieval, checked by common subsequences and answers."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycard.llm.common import docs_of, query, row_key, settled

#: Words of a passage and from one passage to the next.
WINDOW, STRIDE = 48, 24
#: Benchmark items searched for at once. More items are further blocks, each with its own terms and latent space.
ITEMS = 256
#: Terms in more than this share of stretches of STRIDE words carry no weight, as usual with TF-IDF, but for the rarest
#: ones of each item. A passage must have so many distinct weighty terms, or as few as some item has.
MOST_DF, LEAST_TERMS = 0.005, 3
LEAST_COSINE = 0.4
#: Share of an item's words, in order, within a stretch of text: alone, or together with the item's last sentence.
LEAST_SHARE, LEAST_WITH_ANSWER = 0.75, 0.55
#: The share must hold for all words, and for those in at most MOST_COMMON of the stretches, as common words stand in
#: order by chance. An item with fewer than FEW_WORDS of the latter needs a share of LEAST_OF_FEW.
MOST_COMMON, FEW_WORDS, LEAST_OF_FEW = 0.2, 8, 0.9
#: So many of an item's rarest terms always carry weight.
KEPT_TERMS = 8
PAIRS = "id string, key long, item string, cosine double, share double, answer boolean"
_PUNCTUATION = b".,;:!?\"'()[]{}|#*$%&<>-_"


def terms(text: str | None) -> list[bytes]:
    """Words in lower case with punctuation taken out; words of punctuation alone are left out."""
    return text.lower().encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION).split() if text else []


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, one machine operation per word of ``b`` and 64 words of ``a``."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = where.get(x, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def answer_of(text: str | None) -> list[bytes]:
    """Words of an item's last sentence that has at least two."""
    for part in reversed(re.split(r"[.!?\n]+", text or "")):
        if len(own := terms(part)) >= 2:
            return own
    return []


def contains(words: list[bytes], part: list[bytes]) -> bool:
    n = len(part)
    return bool(n) and any(words[i] == part[0] and words[i:i + n] == part for i in range(len(words) - n + 1))


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values of a sorted array starts."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs, as ``np.unique`` gives them, by a plain sort (much faster here)."""
    ordered = np.sort(keys)
    first = _runs(ordered)
    return ordered[first], np.diff(np.append(first, len(ordered)))


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


class Items:
    """A block of benchmark items, with its vocabulary. Small: a bounded number of items."""

    def __init__(self, rows: list[tuple]):
        self.ids = [i for i, _ in rows]
        self.words = [terms(t) for _, t in rows]
        self.answers = [answer_of(t) for _, t in rows]
        self.vocabulary = _Vocabulary({w: k for k, w in enumerate(dict.fromkeys(w for own in self.words for w in own))})
        self.weights = np.zeros(len(self.vocabulary), np.float32)
        self.least = LEAST_TERMS
        self.content: set[bytes] = set()

    def weigh(self, df: np.ndarray, stretches: int) -> None:
        kept = df <= max(MOST_DF * stretches, 5)
        own = [sorted({self.vocabulary[w] for w in words}, key=lambda t: (df[t], t)) for words in self.words]
        for found in own:
            kept[found[:KEPT_TERMS]] = True
        self.weights = np.where(kept, np.log((stretches + 1) / (df + 1)) + 1, 0).astype(np.float32)
        common = df > MOST_COMMON * stretches
        self.content = {w for w, t in self.vocabulary.items() if not common[t]}
        self.least = max(1, min([LEAST_TERMS, *(int(kept[found].sum()) for found in own if found)]))

    def hits(self, documents: list[list[bytes]]):
        """Term (-1: not the benchmark's), document, and stretch of every word of a batch."""
        sizes = np.array([len(d) for d in documents], np.int64)
        get = self.vocabulary.__getitem__
        term = np.concatenate([np.fromiter(map(get, d), np.int32, len(d)) for d in documents]) if len(documents) else np.empty(0, np.int32)
        doc = np.repeat(np.arange(len(documents)), sizes)
        place = np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return term, doc, place // STRIDE, sizes

    def frequencies(self, documents: list[list[bytes]]) -> tuple[np.ndarray, int]:
        """In how many stretches of STRIDE words each term is, and the number of stretches."""
        term, doc, stretch, sizes = self.hits(documents)
        parts = -(-sizes // STRIDE)
        number = (np.cumsum(parts) - parts)[doc] + stretch
        known = term >= 0
        pairs, _ = _distinct(number[known] * len(self.weights) + term[known])
        return np.bincount(pairs % len(self.weights), minlength=len(self.weights)), int(parts.sum())

    def sparse(self, documents: list[list[bytes]]):
        """TF-IDF rows of the passages with enough weighty terms: document, start, and flat (row offsets, terms, weights).

        A passage is two neighbouring stretches. Words outside the vocabulary are orthogonal to every item and are not represented.
        """
        term, doc, stretch, sizes = self.hits(documents)
        weighty = np.flatnonzero(term >= 0)
        weighty = weighty[self.weights[term[weighty]] > 0]
        term, doc, stretch = term[weighty].astype(np.int64), doc[weighty], stretch[weighty]
        parts = np.maximum(-(-sizes // STRIDE), 1)
        base = np.cumsum(parts) - parts
        # each word is in the passage that starts at its stretch and in the one before; the last stretch starts none unless alone
        own = np.minimum(stretch, np.maximum(parts[doc] - WINDOW // STRIDE, 0))
        earlier = stretch - 1
        both = (earlier >= 0) & (earlier != own)
        number = np.concatenate([base[doc] + own, (base[doc] + earlier)[both]])
        keys, count = _distinct(number * len(self.weights) + np.concatenate([term, term[both]]))
        passage, ids = keys // len(self.weights), keys % len(self.weights)
        first = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]])) if len(passage) else np.empty(0, np.int64)
        lengths = np.diff(np.append(first, len(passage)))
        enough = lengths >= self.least
        stay = np.repeat(enough, lengths)
        passage_of, lengths = passage[first[enough]] if len(first) else first, lengths[enough]
        ids, vals = ids[stay], np.sqrt(count[stay]) * self.weights[ids[stay]]
        offsets = np.cumsum(lengths) - lengths
        if len(offsets):
            vals = vals / np.repeat(np.sqrt(np.add.reduceat(vals * vals, offsets)), lengths)
        which = np.searchsorted(base, passage_of, side="right") - 1
        return which, (passage_of - base[which]) * STRIDE, offsets, ids, vals.astype(np.float32)

    def own_rows(self):
        """The items themselves as rows, whatever their length."""
        offsets, ids, vals, which = [], [], [], []
        for k, words in enumerate(self.words):
            tf = Counter(self.vocabulary[w] for w in words)
            row = [(t, c) for t, c in sorted(tf.items()) if self.weights[t] > 0]
            if row:
                v = np.array([np.sqrt(c) * self.weights[t] for t, c in row], np.float32)
                which.append(k)
                offsets.append(len(ids))
                ids += [t for t, _ in row]
                vals += (v / np.sqrt((v * v).sum())).tolist()
        return which, np.array(offsets, np.int64), np.array(ids, np.int64), np.array(vals, np.float32)


def _product(offsets, ids, vals, matrix) -> np.ndarray:
    """Sparse rows times a dense matrix."""
    if not len(offsets):
        return np.zeros((0, matrix.shape[1]), np.float32)
    lines = matrix[ids]
    lines *= vals[:, None]
    return np.add.reduceat(lines, offsets, axis=0)


def _scatter(offsets, ids, vals, rows: np.ndarray, total: np.ndarray) -> None:
    """Add each row, weighted, to the lines of its terms: total += X^T rows."""
    if not len(offsets):
        return
    lengths = np.diff(np.append(offsets, len(ids)))
    of = np.repeat(np.arange(len(offsets)), lengths)
    order = np.argsort(ids, kind="stable")
    names, first = np.unique(ids[order], return_index=True)
    total[names] += np.add.reduceat(rows[of[order]] * vals[order][:, None], first, axis=0)


def latent_basis(sketch: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors from the sketch (A^T A) omega of all rows, by the one-pass Nystrom form of randomised SVD."""
    core = omega.T @ sketch
    core = (core + core.T) / 2
    shift = np.finfo(np.float32).eps * max(float(np.trace(core)), 1e-9)
    values, vectors = np.linalg.eigh(core + shift * np.eye(len(core)))
    root = sketch @ (vectors / np.sqrt(np.maximum(values, shift)))
    u, s, _ = np.linalg.svd(root, full_matrices=False)
    keep = min(rank, int((s > 1e-4 * max(s[0], 1e-12)).sum())) if len(s) else 0
    return u[:, :max(keep, 1)].astype(np.float32)


def _batches(rows: Iterator[pd.DataFrame], words: int = 400_000) -> Iterator[tuple[list, list, list[list[bytes]]]]:
    for batch in rows:
        ids, keys, held, size = [], [], [], 0
        for i, key, text in zip(batch["id"], batch["key"], batch["text"]):
            own = terms(text)
            ids.append(i)
            keys.append(key)
            held.append(own)
            size += len(own)
            if size >= words:
                yield ids, keys, held
                ids, keys, held, size = [], [], [], 0
        if held:
            yield ids, keys, held


def _search_block(rows: DataFrame, block: list[tuple], rank: int) -> DataFrame:
    spark = rows.sparkSession
    items = Items(block)
    size = len(items.vocabulary)
    if not size:
        return spark.createDataFrame([], PAIRS)
    shared = spark.sparkContext.broadcast(items)  # a bounded number of items

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(size + 1, np.int64)  # the last place counts stretches
        for _, _, held in _batches(batches):
            found, stretches = shared.value.frequencies(held)
            df[:size] += found
            df[size] += stretches
        at = np.flatnonzero(df)
        yield pd.DataFrame({"term": at, "n": df[at]})

    counted = rows.mapInPandas(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = np.zeros(size + 1, np.int64)
    for r in counted.collect():  # one row per term of the block
        df[r["term"]] = r["n"]
    items.weigh(df[:size], int(df[size]))
    which, offsets, ids, vals = items.own_rows()
    rank = min(rank, size)
    width = min(rank + 8, size)
    omega = np.random.default_rng(7).standard_normal((size, width)).astype(np.float32)
    weighed = spark.sparkContext.broadcast(items)

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, keys, held in _batches(batch.to_pandas() for batch in batches):
            d, start, o, t, v = weighed.value.sparse(held)
            if len(d):
                # the sparse rows go out as Arrow lists over the flat terms and weights, not as an array object per row
                end = pa.array(np.append(o, len(t)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.array([doc_ids[k] for k in d], pa.string()), pa.array(np.array(keys, np.int64)[d]), pa.array(start.astype(np.int32)),
                    pa.ListArray.from_arrays(end, pa.array(t.astype(np.int32))), pa.ListArray.from_arrays(end, pa.array(v.astype(np.float32)))],
                    ["id", "key", "start", "terms", "weights"])

    # the passages that can resemble an item at all, as sparse rows
    table = settled(rows.mapInArrow(passages, "id string, key long, start int, terms array<int>, weights array<float>"))

    # passages are short, so the sketch (A^T A) omega goes by pairs of terms: sums per pair over all passages, then a line per term
    pairs = table.select("terms", "weights").mapInArrow(_term_pairs(size), "a int, b int, x double").groupBy("a", "b").agg(F.sum("x").alias("x"))

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for part in batches:
            part = part.sort_values("a", kind="stable")
            first = _runs(part["a"].to_numpy())
            names = part["a"].to_numpy()[first]
            for at in range(0, len(names), 1024):
                lo, hi = first[at], first[at + 1024] if at + 1024 < len(first) else len(part)
                some = part.iloc[lo:hi]
                found = np.add.reduceat(omega[some["b"].to_numpy()] * some["x"].to_numpy(np.float64)[:, None], first[at: at + 1024] - lo, axis=0)
                for name, line in zip(names[at: at + 1024].tolist(), found):
                    total[name] = total[name] + line if name in total else line
        if total:
            yield pd.DataFrame({"term": list(total), "line": [v.tolist() for v in total.values()]})

    sketch = np.zeros(omega.shape, np.float64)
    for r in pairs.repartition("a").mapInPandas(lines, "term int, line array<double>").collect():  # terms x rank numbers
        sketch[r["term"]] = r["line"]
    own = np.zeros_like(omega)
    _scatter(offsets, ids, vals, _product(offsets, ids, vals, omega), own)
    # the items are rows of the matrix too, with as much weight in all as the corpus has: what is asked for is in the space
    heavy = max(1.0, float(np.abs(sketch).sum()) / max(float(np.abs(own).sum()), 1e-9))
    basis = latent_basis(sketch + heavy * own, omega.astype(np.float64), rank)
    wanted = _product(offsets, ids, vals, basis)
    wanted /= np.maximum(np.linalg.norm(wanted, axis=1, keepdims=True), 1e-9)
    # a row's place in the latent space, then its product with the items there
    space = spark.sparkContext.broadcast((basis, wanted.T.astype(np.float64), np.array(which)))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, items_t, which = space.value
        for part in batches:
            for at in range(0, part.num_rows, 4096):
                some = part.slice(at, 4096)
                placed = _product(*_flat(some), basis).astype(np.float64)
                cosines = placed @ items_t
                cosines /= np.maximum(np.linalg.norm(placed, axis=1, keepdims=True), 1e-9)
                p, k = np.nonzero(cosines >= LEAST_COSINE)
                if len(p):
                    at_p = pa.array(p)
                    yield pa.RecordBatch.from_arrays([some.column("id").take(at_p), some.column("key").take(at_p), some.column("start").take(at_p),
                                                      pa.array(which[k].astype(np.int32)), pa.array(cosines[p, k].astype(float))],
                                                     ["id", "key", "start", "item", "cosine"])

    candidates = settled(table.mapInArrow(near, "id string, key long, start int, item int, cosine double"))
    # at most the passages of one text times the items of the block
    grouped = candidates.groupBy("id", "key").agg(F.collect_set(F.struct("item", "start", "cosine")).alias("found")).toDF("id2", "key2", "found")
    texts = rows.join(settled(grouped), (F.col("key") == F.col("key2")) & F.col("id").eqNullSafe(F.col("id2"))).select("id", "key", "text", "found")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = weighed.value
        for batch in batches:
            out = []
            for doc_id, key, text, found in zip(batch["id"], batch["key"], batch["text"], batch["found"]):
                words, best = terms(text), {}
                for x in found:
                    k, item = x["item"], items.words[x["item"]]
                    region = words[max(0, x["start"] - len(item)): x["start"] + WINDOW + len(item)]
                    told = [w for w in item if w in items.content]
                    share = common_subsequence(item, region) / len(item)
                    if told:
                        share = min(share, common_subsequence(told, [w for w in region if w in items.content]) / len(told))
                    answered = share >= LEAST_WITH_ANSWER and contains(region, items.answers[k])
                    best[k] = max(best.get(k, (0.0, 0.0, False)), (share, x["cosine"], answered))
                for k, (share, cosine, answered) in sorted(best.items()):
                    telling = sum(w in items.content for w in items.words[k]) >= FEW_WORDS
                    if share >= (LEAST_SHARE if telling else LEAST_OF_FEW) or (share >= LEAST_WITH_ANSWER and answered):
                        out.append((doc_id, key, items.ids[k], cosine, share, answered))
            yield pd.DataFrame(out, columns=["id", "key", "item", "cosine", "share", "answer"])

    return texts.mapInPandas(check, PAIRS)


def _term_pairs(size: int, at_once: int = 2_000_000):
    """Sums of products of two terms' weights over passages, both orders, one row per pair and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, waiting = np.empty(0, np.int64), np.empty(0, np.float64), []

        def merged():
            every = np.concatenate([keys, *[k for k, _ in waiting]])
            values = np.concatenate([sums, *[v for _, v in waiting]])
            order = np.argsort(every, kind="stable")
            first = _runs(every[order])
            # sums in the order the values came, as a count by weights gives them
            return every[order][first], np.add.reduceat(values[order], first) if len(first) else values[:0]

        for part in batches:
            offsets, ids, vals = _flat(part)
            lengths = np.diff(np.append(offsets, len(ids)))
            # every term of a passage with every term of it
            times = np.repeat(lengths, lengths)
            left = np.repeat(np.arange(len(ids)), times)
            right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(np.repeat(offsets, lengths), times)
            waiting.append((ids[left] * size + ids[right], vals[left].astype(np.float64) * vals[right]))
            if sum(len(k) for k, _ in waiting) >= at_once:
                keys, sums = merged()
                waiting = []
        keys, sums = merged() if waiting else (keys, sums)
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array((keys // size).astype(np.int32)), pa.array((keys % size).astype(np.int32)), pa.array(sums)], ["a", "b", "x"])

    return run


def _flat(part: pa.RecordBatch):
    """Row offsets, terms and weights of sparse rows, read from the Arrow lists as they are."""
    if not part.num_rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    terms, weights = part.column("terms"), part.column("weights")
    ends = terms.offsets.to_numpy().astype(np.int64)
    return ends[:-1] - ends[0], terms.flatten().to_numpy().astype(np.int64), weights.flatten().to_numpy().astype(np.float32)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text: str = "text", rank: int = ITEMS) -> DataFrame:
    """Pairs of documents and benchmark items they hold: id, ``content_key``, item, ``cosine``, ``share``, ``answer``.

    Passages of all texts are TF-IDF rows over the benchmark's terms; frequencies and the sketch of the randomised SVD are
    sums over all passages. Passages near an item in the latent space are candidates. A candidate counts when the item's
    words occur in order around it, nearly all, or a good part and the item's last sentence in one piece. Words that are
    common in the corpus do not count there. One row per
    pair; repeated rows give a row each. Null or empty texts and items match nothing. Of items with equal texts each is reported.
    """
    # ids travel as text through Python, as null numbers would lose digits on the way
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key")).filter(F.length("text") > 0)
    asked = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).filter(F.length("text") > 0)
    id_type, item_type = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    found, block = None, []

    def search(block):
        return _search_block(rows, block, rank)

    for r in asked.orderBy("item", "text").toLocalIterator():  # the stated query set, a block at a time
        block.append((r["item"], r["text"]))
        if len(block) == ITEMS:
            found = search(block) if found is None else found.unionByName(search(block))
            block = []
    if block or found is None:
        found = search(block) if found is None else found.unionByName(search(block))
    return found.select(F.col("id").cast(id_type).alias(id_col), F.col("key").alias("content_key"), F.col("item").cast(item_type).alias(item_col), "cosine", "share", "answer")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they are."""
    bad = contaminated(docs, benchmark, id_col, text_col)
    bad = settled(bad.select(F.col(id_col).alias("bad_id"), F.col("content_key").alias("bad_key")).distinct())
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"))
    return rows.join(bad, rows["id"].eqNullSafe(bad["bad_id"]) & (rows["key"] == bad["bad_key"]), "left_anti").select("row.*")


@query("op7_latent_decontamination")
def op7_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(docs_of(spark, sf_dir), docs_of(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("cosine", 4).alias("cosine"), F.round("share", 4).alias("share"), "answer")
