"""Two tokenizers over the same texts: which tokens cover the same bytes, and which ids go together corpus-wide."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycard.llm.bpe import Codec, vocabulary
from tallycard.llm.common import docs_of, query, settled

#: Bytes of text that go through the Arrow tables at a time, and id pairs of documents that share one table of counts.
#: Both bound memory only, never a result. A text is never split over blocks.
CHUNK_BYTES, BLOCK_PAIRS = 1_500_000, 500_000
#: Units of text that a worker remembers; then it starts anew.
MEMO_UNITS = 150_000
#: Neither tokenizer has a token over such a place: a space after something else, with text behind it.
CUT = re.compile(r"(?<=[^\s▁])(?= .)", re.S)
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")

_LOADED: dict[int, Tokens] = {}


class Tokens:
    """Both vocabularies in a worker: ids of units of text, and the bytes of each id as Arrow arrays."""

    def __init__(self, spec: str, model: bytes):
        import sentencepiece

        codec = Codec(spec)
        self.a = codec.tokenizer
        self.a.encode_special_tokens = True  # their strings inside texts are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a_bytes = pa.array(codec.bytes, pa.binary())
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        as_byte = [BYTE_PIECE.fullmatch(p) for p in pieces]
        self.b_bytes = pa.array([bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode() for m, p in zip(as_byte, pieces)], pa.binary())
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("pieces go on after a space: texts can not be cut at spaces")
        self.decimal = pa.array([str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))])
        self.memo: dict[str, tuple[list[int], list[int]]] = {}

    def ids(self, units: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both tokenizers for units that begin with a space."""
        new = [u for u in units if u not in self.memo]
        if new:
            if len(self.memo) + len(new) > MEMO_UNITS:
                self.memo, new = {}, units
            a = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
            b = self.b.encode([u[1:] for u in new], num_threads=1)
            self.memo.update(zip(new, zip(a, b)))
        return list(map(self.memo.__getitem__, units))


def _tokens(shared) -> Tokens:
    key = hash(shared.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokens(*shared.value)
    return _LOADED[key]


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])


def _side(lists: pa.ListArray, unit_doc: pa.Array, width: pa.Array, name: str) -> pa.Table:
    """A row per token: document, end byte within the document, id, position."""
    ids = pc.list_flatten(lists)
    doc = unit_doc.take(pc.list_parent_indices(lists))
    total = pc.cumulative_sum(width.take(ids))
    # segmented: what was summed before the document's first token comes off
    docs, first = np.unique(doc.to_numpy(), return_index=True)
    start = np.concatenate([np.zeros(1, np.int64), total.to_numpy()])[first]
    base = np.zeros(int(docs[-1]) + 1 if len(docs) else 0, np.int64)
    base[docs] = start
    end = pc.subtract(total, pa.array(base).take(doc))
    return pa.table({"doc": doc, "end": end, name: ids, f"pos_{name}": pa.array(np.arange(len(ids))), "at": total})


def _shared_ends(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the tokens of each side that end where one of the other side ends, in the same document."""
    at_a, at_b = a["at"].to_numpy(), b["at"].to_numpy()
    # both sides spell the same bytes, so their running byte counts are one coordinate; where every token has bytes,
    # these rise strictly and an end of a document is no end of another
    if len(at_a) and len(at_b) and at_a[0] > 0 and at_b[0] > 0 and (np.diff(at_a) > 0).all() and (np.diff(at_b) > 0).all():
        k = np.minimum(np.searchsorted(at_b, at_a), len(at_b) - 1)
        hit = at_b[k] == at_a
        return np.flatnonzero(hit), k[hit]
    shared = a.select(["doc", "end", "pos_a"]).join(b.select(["doc", "end", "pos_b"]), keys=["doc", "end"], join_type="inner", use_threads=False)
    return shared["pos_a"].to_numpy(), shared["pos_b"].to_numpy()


def _spelled(lists: pa.ListArray, spelling: pa.Array, units: pa.Array) -> np.ndarray:
    """For each unit, whether the bytes of its tokens are its own."""
    token = spelling.take(pc.list_flatten(lists))
    sizes = pc.binary_length(token).to_numpy()
    mine = _offsets(sizes)[_offsets(pc.list_value_length(lists).to_numpy())]
    wanted = _offsets(pc.binary_length(units.cast(pa.binary())).to_numpy())
    got, text = (np.frombuffer(x.buffers()[2] or b"", np.uint8) for x in (token, units))
    if np.array_equal(mine, wanted) and np.array_equal(got, text):
        return np.ones(len(units), bool)
    return np.array([np.array_equal(got[mine[k]:mine[k + 1]], text[wanted[k]:wanted[k + 1]]) for k in range(len(units))], bool)


def align_units(tokens: Tokens, units: list[str], unit_doc: np.ndarray, form: str) -> tuple[set[int], dict[int, list], pa.Table]:
    """Align one chunk. Units of one document follow each other.

    Returns documents whose bytes one tokenizer does not give back, then per document the counts of tokens, groups and
    links and its groups (as one text per document, or as lists), then a table doc, a, b, links.
    """
    texts = pa.array(units, pa.string())
    coded = texts.dictionary_encode()
    found = tokens.ids(coded.dictionary.to_pylist())
    lists = [pa.array([f[k] for f in found], pa.list_(pa.int32())).take(coded.indices) for k in (0, 1)]
    spellings = (tokens.a_bytes, tokens.b_bytes)
    good = _spelled(lists[0], spellings[0], texts) & _spelled(lists[1], spellings[1], texts)
    wrong = set(unit_doc[~good].tolist())
    if wrong:
        stay = pa.array(~np.isin(unit_doc, list(wrong)))
        lists, unit_doc = [x.filter(stay) for x in lists], unit_doc[stay.to_numpy(zero_copy_only=False)]
    nothing = pa.table({"doc": pa.array([], pa.int32()), "a": pa.array([], pa.int32()), "b": pa.array([], pa.int32()), "links": pa.array([], pa.int64())})
    if not len(unit_doc):
        return wrong, {}, nothing
    widths = [pc.binary_length(s).cast(pa.int64()) for s in spellings]
    of_unit = pa.array(unit_doc, pa.int32())
    a, b = _side(lists[0], of_unit, widths[0], "a"), _side(lists[1], of_unit, widths[1], "b")
    groups, ends = [], []
    for side, pos in zip((a, b), _shared_ends(a, b)):
        flag = np.zeros(len(side), np.int64)
        flag[pos] = 1
        groups.append(np.cumsum(flag) - flag)
        ends.append(np.flatnonzero(flag) + 1)
    group_doc = a["doc"].to_numpy()[ends[0] - 1]
    # links: one token of each in a group is a pair as it is; elsewhere tokens are counted per id before ids meet
    single = (np.diff(ends[0], prepend=0) == 1) & (np.diff(ends[1], prepend=0) == 1)
    alone = pa.table({"doc": pa.array(group_doc[single], pa.int32()), "a": a["a"].take(pa.array(ends[0][single] - 1)), "b": b["b"].take(pa.array(ends[1][single] - 1)),
                      "links": pa.array(np.ones(int(single.sum()), np.int64))})
    per = [pa.table({"group": pa.array(g), name: side[name]}).filter(pa.array(~single[g])).group_by(["group", name], use_threads=False).aggregate([([], "count_all")]).rename_columns(["group", name, f"n_{name}"])
           for g, side, name in ((groups[0], a, "a"), (groups[1], b, "b"))]
    met = per[0].join(per[1], keys="group", join_type="inner", use_threads=False)
    met = pa.table({"doc": pa.array(group_doc, pa.int32()).take(met["group"]), "a": met["a"], "b": met["b"], "links": pc.multiply(met["n_a"], met["n_b"])})
    pairs = pa.concat_tables([alone, met]).group_by(["doc", "a", "b"], use_threads=False).aggregate([("links", "sum")]).rename_columns(["doc", "a", "b", "links"])

    docs, first = np.unique(group_doc, return_index=True)
    edges = np.append(first, len(group_doc))
    n_links = np.bincount(pairs["doc"].to_numpy(), weights=pairs["links"].to_numpy(), minlength=int(docs[-1]) + 1)
    cuts = [pa.array(np.concatenate([[0], e]), pa.int32()) for e in ends]
    if form == "digests":
        texts = [pc.binary_join(pa.ListArray.from_arrays(c, tokens.decimal.take(s[n].combine_chunks())), ",") for c, s, n in ((cuts[0], a, "a"), (cuts[1], b, "b"))]
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pc.binary_join_element_wise(*texts, "|")), ";").to_pylist()
    else:
        both = pa.StructArray.from_arrays([pa.ListArray.from_arrays(c, s[n].combine_chunks()) for c, s, n in ((cuts[0], a, "a"), (cuts[1], b, "b"))], names=["a", "b"])
        whole = [both.slice(edges[k], edges[k + 1] - edges[k]) for k in range(len(docs))]
    upto = [np.concatenate([[0], e])[edges] for e in ends]
    counts = zip(docs.tolist(), np.diff(upto[0]).tolist(), np.diff(upto[1]).tolist(), np.diff(edges).tolist(), n_links[docs].astype(np.int64).tolist(), whole)
    return wrong, {d: [n_a, n_b, n_groups, links, w] for d, n_a, n_b, n_groups, links, w in counts}, pairs


GROUPS = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
FORMS = {"digests": ("groups_sha256", pa.string(), "string"), "groups": ("groups", GROUPS, "array<struct<a: array<int>, b: array<int>>>")}


class _Block:
    """Documents of one task that share a table of id pairs."""

    def __init__(self, form: str):
        self.form = form
        self.ids: list = []
        self.sums: list[list[int]] = []
        self.groups: list = []
        self.wrong: set[int] = set()
        self.pairs: list[pa.Table] = []
        self.rows = 0
        self.split = False  # is a text in several chunks?

    def open(self, doc_id) -> int:
        self.ids.append(doc_id)
        self.sums.append([0, 0, 0, 0])
        self.groups.append(hashlib.sha256() if self.form == "digests" else [])
        return len(self.ids) - 1

    def add(self, wrong: set[int], found: dict[int, list], pairs: pa.Table) -> None:
        self.wrong |= wrong
        for doc, (*sums, whole) in found.items():
            if self.form == "digests":
                self.groups[doc].update((";" if self.sums[doc][0] else "").encode() + whole.encode())
            else:
                self.groups[doc].append(whole)
            self.sums[doc] = [x + y for x, y in zip(self.sums[doc], sums)]
        self.pairs.append(pairs)
        self.rows += len(pairs)

    def close(self, number: int, id_type: pa.DataType, names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        """A row per document with places in the block's table of pairs, then the table itself."""
        n = len(self.ids)
        table = pa.concat_tables(self.pairs) if self.pairs else None
        if table is not None and self.wrong:
            table = table.filter(pa.array(~np.isin(table["doc"].to_numpy(), list(self.wrong))))
        if table is None or not len(table):
            lists = [pa.array([[]] * n, pa.list_(pa.int32())), pa.array([[]] * n, pa.list_(pa.int64()))]
            seen = None
        else:
            if self.split:
                table = table.group_by(["doc", "a", "b"], use_threads=False).aggregate([("links", "sum")]).rename_columns(["doc", "a", "b", "links"])
            seen = table.group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["a", "b", "docs"])
            seen = seen.append_column("slot", pa.array(np.arange(len(seen)), pa.int32()))
            placed = table.join(seen.select(["a", "b", "slot"]), keys=["a", "b"], join_type="inner", use_threads=False).combine_chunks()
            doc = placed["doc"].to_numpy()
            order = np.argsort(doc, kind="stable")
            cuts = pa.array(_offsets(np.bincount(doc, minlength=n)), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, placed[c].combine_chunks().take(pa.array(order))) for c in ("slot", "links")]
        bad = [d in self.wrong for d in range(n)]
        sums = [pa.array([0 if bad[d] else s[k] for d, s in enumerate(self.sums)], pa.int64()) for k in range(4)]
        if self.form == "digests":
            groups = pa.array(["" if bad[d] or not self.sums[d][0] else g.hexdigest() for d, g in enumerate(self.groups)], pa.string())
        else:
            groups = [[] if bad[d] or not g else pa.concat_arrays(g).to_pylist() for d, g in enumerate(self.groups)]
            groups = pa.array(groups, GROUPS)
        rows = {"block": pa.array([number] * n, pa.int64()), "id": pa.array(self.ids, id_type), **dict(zip(("n_a", "n_b", "n_groups", "n_links"), sums)),
                "groups": groups, "slots": lists[0], "links": lists[1]}
        yield self._batch(rows, n, names, types)
        if seen is not None:
            for part in seen.to_batches(max_chunksize=100_000):
                rows = {c: part.column(c) for c in ("a", "b", "docs", "slot")}
                yield self._batch(rows | {"block": pa.array([number] * len(part), pa.int64())}, len(part), names, types)

    @staticmethod
    def _batch(rows: dict, n: int, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows[c] if c in rows else pa.nulls(n, t) for c, t in zip(names, types)], names=names)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", form: str = "groups",
          chunk_bytes: int = CHUNK_BYTES, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, and the groups of every row of ``docs``.

    ``a_path`` is a byte-level file of the tokenizers library, used on a space and the text; ``b_path`` a sentencepiece
    model that adds the space itself. ``form`` "groups" gives the groups as lists of ids, "digests" a digest of them.
    Tasks align their texts in Arrow tables and write, per block of texts, the texts' id pairs as places in the block's
    table of distinct pairs, and that table with the number of texts per pair. Spark adds these up over blocks; what it
    finds goes back to each block once per distinct pair, not once per text and pair.

    A null or empty text, or one whose bytes one of the two does not give back, has zeros and no groups. Repeated rows
    and rows of one id are documents of their own, null ids too; an empty table gives an empty one; other columns are
    left out. A very long text goes through the tables in chunks. Distinct ids of a group all meet, as that is what is
    asked for: a text in which both tokenizers share no end for long makes as many pairs as it has distinct ids squared.
    """
    spark = docs.sparkSession
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        shared = spark.sparkContext.broadcast((f.read(), g.read()))  # vocabulary files of fixed sizes
    id_type = docs.schema[id_col].dataType.simpleString()
    groups_name, groups_type, groups_sql = FORMS[form]
    columns = {"block": ("long", pa.int64()), "id": (id_type, None), **{c: ("long", pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")},
               "groups": (groups_sql, groups_type), "slots": ("array<int>", pa.list_(pa.int32())), "links": ("array<long>", pa.list_(pa.int64())),
               "a": ("int", pa.int32()), "b": ("int", pa.int32()), "docs": ("long", pa.int64()), "slot": ("int", pa.int32())}

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, number = _tokens(shared), TaskContext.get().partitionId() << 32
        block, units, owner, size, types = _Block(form), [], [], 0, None
        def flush() -> None:
            nonlocal units, owner, size
            if units:
                block.add(*align_units(tokens, units, np.array(owner, np.int32), form))
            units, owner, size = [], [], 0

        for batch in batches:
            own_type = batch.schema.field("id").type
            types = [own_type if t is None else t for _, t in columns.values()]
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                doc, text = block.open(doc_id), text.as_py()
                cut = CUT.split(" " + text) if text else []
                if text and len(text) > chunk_bytes:
                    for unit in cut:
                        units.append(unit)
                        owner.append(doc)
                        size += len(unit)
                        if size >= chunk_bytes:
                            block.split = True
                            flush()
                elif cut:
                    units += cut
                    owner += [doc] * len(cut)
                    size += len(text)
                if size >= chunk_bytes:
                    flush()
                if block.rows >= block_pairs or len(block.ids) >= block_pairs:
                    flush()
                    yield from block.close(number, own_type, list(columns), types)
                    block, number = _Block(form), number + 1
        if block.ids:
            flush()
            yield from block.close(number, own_type, list(columns), types)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    both = settled(rows.mapInArrow(aligned, ", ".join(f"{c} {t}" for c, (t, _) in columns.items())))
    texts = both.filter("slot is null").select("block", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "slots", "links")
    pairs = both.filter("slot is not null").select("block", "a", "b", "docs", "slot")
    counts = settled(pairs.groupBy("a", "b").agg(F.sum("docs").alias("count")))
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    known = counts.join(top, "a").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))
    back = pairs.join(known, ["a", "b"]).select(F.col("block").alias("of"), "slot", "count", "best")

    def summed(texts: pa.Table, known: pa.Table) -> pa.Table:
        n = len(known)
        count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        slot = known["slot"].to_numpy()
        count[slot], best[slot] = known["count"].to_numpy(), known["best"].to_numpy()
        slots, links = texts["slots"].combine_chunks(), texts["links"].combine_chunks()
        sums = []
        cuts = _offsets(pc.list_value_length(slots).to_numpy())
        at, weight = pc.list_flatten(slots).to_numpy(), pc.list_flatten(links).to_numpy()
        for value in (best, count):
            total = _offsets(value[at] * weight)
            sums.append(pa.array(total[cuts[1:]] - total[cuts[:-1]], pa.int64()))
        return pa.table({"id": texts["id"], **{c: texts[c] for c in ("n_a", "n_b", "n_groups", "n_links")},
                         "n_best": sums[0], "count_sum": sums[1], groups_name: texts["groups"]})

    result = f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, {groups_name} {groups_sql}"
    done = texts.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(summed, result)
    return done.withColumnRenamed("id", id_col)


@query("op12_cross_tokenizer")
def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of a byte-level and a piece vocabulary over all documents."""
    return align(docs_of(spark, sf_dir), vocabulary(), vocabulary("piece_bpe_32k.model"), form="digests")
