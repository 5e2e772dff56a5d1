"""Byte-level BPE: whole texts to ids and back, long texts by tree concatenation."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycard.llm.common import docs_of, query, row_key

#: A text longer than this is cut in pieces that are encoded by different tasks.
LONG_CHARS = 32_768
#: Pre-split units that a worker remembers; then it starts anew. Bounds memory only, never a result.
MEMO_UNITS = 400_000
_TO_BYTES: dict[str, int] = {}
_LOADED: dict[int, Codec] = {}


def _byte_of() -> dict[str, int]:
    """Byte of each letter of the byte-level alphabet: printable Latin-1 stands for itself, the rest follow from 256 on."""
    if not _TO_BYTES:
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        _TO_BYTES.update({chr(b): b for b in plain})
        _TO_BYTES.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)})
    return _TO_BYTES


class _Memo(dict):
    """Ids of units; long units are not kept, and a full memo starts anew."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, unit: str) -> tuple[int, ...]:
        ids = tuple(self.tokenizer.encode(unit, add_special_tokens=False).ids)
        if len(unit) <= 64:
            if len(self) >= MEMO_UNITS:
                self.clear()
            self[unit] = ids
        return ids


class Codec:
    """Encodes and decodes with one vocabulary. ``spec`` is the text of a tokenizers file."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        table, to_byte = {}, _byte_of()
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            table[i] = added[i].content.encode() if i in added else bytes(to_byte[c] for c in token)
        self.bytes = [table.get(i, b"") for i in range(max(table) + 1)]
        self.widths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.digits = [str(i) for i in range(len(self.bytes))]
        self.memo = _Memo(self.tokenizer)

    def _units(self, text: str) -> list[str]:
        """Cut before each space or newline that follows something else than white space.

        No token spans such a place: white space starts a token or stands among white space only, and what follows is
        split the same way whatever stands before.
        """
        if re.search(r"\s[ \n]", text):
            return re.split(r"(?<=\S)(?=[ \n])", text)
        units: list[str] = []
        for k, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            units.append("\n" + first if k else first)
            units += [" " + x for x in rest]
        return units

    def encode(self, text: str) -> list[int]:
        units = self._units(text)
        return list(chain.from_iterable(map(self.memo.__getitem__, units)))

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def _ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.widths[ids])

    def join(self, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray], window: int = 128) -> tuple[str, np.ndarray]:
        """Concatenate two encoded texts.

        A window around the join is encoded anew. It replaces the old ids between a token that window and left share at
        the same bytes and a token that window and right share. Every neighbouring pair of the result then stands in
        the encoding of a longer text, and a sequence all of whose pairs do is the encoding of its text. While no
        shared token is found on a side, the window grows on both, at last to all the text.
        """
        (lt, li), (rt, ri) = left, right
        if not lt or not rt:
            return (lt + rt, np.concatenate([li, ri]))
        while True:
            a, b = lt[-window:], rt[:window]
            w = np.asarray(self.tokenizer.encode(a + b, add_special_tokens=False).ids, dtype=np.int32)
            ends = self._ends(w)
            na, nb = len(a.encode()), len(b.encode())
            low = high = None  # so many ids of the window go at its start; so many stay
            keep_left = keep_right = None
            if len(a) == len(lt):
                low, keep_left = 0, 0
            else:
                tail, k = [], len(li)
                width = 0
                while k > 0 and width + self.widths[li[k - 1]] <= na:
                    k -= 1
                    width += int(self.widths[li[k]])
                    tail.append((na - width, int(li[k]), k))
                at = {(int(e - self.widths[i]), int(i)): n for n, (e, i) in enumerate(zip(ends, w))}
                # not the last tokens of left, which the end of its text has shaped
                for start, i, k in tail:
                    if (start, i) in at and start + self.widths[i] <= na - 16:
                        low, keep_left = at[(start, i)] + 1, k + 1
                        break
            if len(b) == len(rt):
                high, keep_right = len(w), len(ri)
            else:
                at = {(int(e - self.widths[i]), int(i)): n for n, (e, i) in enumerate(zip(ends, w))}
                start, k = na, 0
                while k < len(ri) and start + self.widths[ri[k]] <= na + nb:
                    if start >= na + 16 and (start, int(ri[k])) in at:
                        high, keep_right = at[(start, int(ri[k]))], k
                        break
                    start += int(self.widths[ri[k]])
                    k += 1
            if low is not None and high is not None and low <= high:
                return (lt + rt, np.concatenate([li[:keep_left], w[low:high], ri[keep_right:]]).astype(np.int32))
            window *= 2

    def concatenate(self, parts: list[tuple[str, np.ndarray]]) -> np.ndarray:
        """Join neighbours pair by pair until one is left."""
        while len(parts) > 1:
            parts = [self.join(*parts[k:k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0][1] if parts else np.empty(0, np.int32)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file, the default parameter of the queries."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _codec(spec) -> Codec:
    """One codec per worker process and vocabulary, with its memo."""
    text = spec.value
    key = hash(text)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Codec(text)
    return _LOADED[key]


def _ids_row(codec: Codec, ids) -> tuple:
    return (np.asarray(ids, dtype=np.int32),)


def _digest_row(codec: Codec, ids) -> tuple:
    ids = ids if isinstance(ids, list) else ids.tolist()
    joined = ",".join(map(codec.digits.__getitem__, ids))
    return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()


FORMS: dict[str, tuple[str, Callable]] = {
    "ids": ("ids array<int>", _ids_row),
    "digests": ("n_tokens long, ids_sha256 string, decoded_sha256 string", _digest_row),
}


def encode_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", form: str = "ids",
                     long_chars: int = LONG_CHARS) -> DataFrame:
    """Encode every whole text. ``form`` "ids" gives an array of ids, "digests" their count and the digests of ids and decoded text.

    Texts of up to ``long_chars`` are encoded in one go. Longer ones are cut into pieces that are encoded in parallel as
    rows of their own, wherever the cut falls; a task then concatenates the pieces of a text pair by pair.
    A null text is empty and has no ids. Rows that agree in id and text give one result each. The id is returned as it is,
    null included; other columns are left out.
    """
    spark = docs.sparkSession
    with open(vocab_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a vocabulary file of fixed size
    schema, shape = FORMS[form]
    names = [x.split()[0] for x in schema.split(", ")]
    # ids travel as text through Python, as null numbers would lose digits on the way
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            codec = _codec(spec)
            got = [shape(codec, codec.encode(t)) for t in rows["text"]]
            yield pd.DataFrame({"id": rows["id"], **{c: [g[k] for g in got] for k, c in enumerate(names)}})

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            codec = _codec(spec)
            rows["ids"] = [np.asarray(codec.encode(t), dtype=np.int32) for t in rows["piece"]]
            yield rows

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        codec = _codec(spec)
        rows = rows.sort_values(["copy", "n"], kind="stable")
        got, ids = [], []
        for _, own in rows.groupby("copy", sort=True):
            got.append(shape(codec, codec.concatenate([(t, np.asarray(i, dtype=np.int32)) for t, i in zip(own["piece"], own["ids"])])))
            ids.append(own["id"].iloc[0])
        return pd.DataFrame({"id": pd.Series(ids, dtype=rows["id"].dtype), **{c: [g[k] for g in got] for k, c in enumerate(names)}})

    result = f"id string, {schema}"
    length = F.length("text")
    short = rows.filter(length <= long_chars).mapInPandas(whole, result)
    # repeated rows are kept apart by a number that their pieces share
    long = rows.filter(length > long_chars).groupBy("id", "text").agg(F.count("*").alias("copies")).withColumn("key", row_key("id", "text"))
    n = F.ceil(F.length("text") / long_chars).cast("int")
    cut = long.select(
        "id", "key", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "text", n.alias("of"),
    ).select("id", "key", "copy", F.explode(F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda i: F.struct(
        i.alias("n"), F.substring(F.col("text"), i * long_chars + 1, F.lit(long_chars)).alias("piece")))).alias("p"))
    cut = cut.select("id", "key", "copy", "p.n", "p.piece").repartition("key", "copy", "n")
    done = cut.mapInPandas(pieces, "id string, key long, copy long, n int, piece string, ids array<int>")
    out = short.unionByName(done.groupBy("id", "key").applyInPandas(joined, result))
    return out.withColumn("id", F.col("id").cast(id_type)).withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Ids back to text; null ids give an empty text, invalid bytes the replacement character."""
    with open(vocab_path, encoding="utf-8") as f:
        spec = encoded.sparkSession.sparkContext.broadcast(f.read())
    id_type = encoded.schema[id_col].dataType
    rows = encoded.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            codec = _codec(spec)
            yield pd.DataFrame({"id": rows["id"], "text": [codec.decode(i) for i in rows["ids"]]})

    out = rows.mapInPandas(decode, "id string, text string")
    return out.select(F.col("id").cast(id_type).alias(id_col), F.col("text").alias(text_col))


@query("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return encode_documents(docs_of(spark, sf_dir), vocabulary(), form="digests")
