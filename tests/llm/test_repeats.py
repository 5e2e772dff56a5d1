import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallycard.llm import chunks, repeats
from tallycard.llm.suffix_array import permuted_prefixes, suffix_array


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=120) | st.lists(st.integers(0, 4000), max_size=60))
def test_suffix_array_and_prefixes(values):
    t = np.array(values, np.int64)
    sa = suffix_array(t)
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: values[i:])
    common = permuted_prefixes(t, sa) if len(t) else []
    for a, b in zip(sa[:-1], sa[1:]):
        k = 0
        while max(a, b) + k < len(t) and values[a + k] == values[b + k]:
            k += 1
        assert common[b] == k


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if count[d[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("most", [1500, 2])
def test_against_brute_force(spark, odd_rows, odd, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST_REGIONS", most)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 3000)
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdef ") for _ in range(330))
    extra = [(100 + k, "".join(rng.choice("abcdefg ") for _ in range(rng.randrange(400))) + passage[rng.randrange(60):] + "".join(rng.choice("abc") for _ in range(90)), *odd_rows[0][2:]) for k in range(30)]
    df = odd.unionByName(spark.createDataFrame(extra, odd.schema))
    got = repeats.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    rows = [*odd_rows, *extra]
    want = [(r[0], *w) for r, w in zip(rows, brute([r[1] for r in rows], 200))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty(spark, none):
    assert repeats.remove_repeats(none).count() == 0
    assert chunks.deduplicate_chunks(none).count() == 0


def test_chunks_against_brute_force(odd, odd_rows):
    seen, want = set(), []
    place = []
    rows = {(r[0], r[1]) for r in odd_rows}
    keyed = {(r["doc_id"], r["text"]): r["k"] for r in odd.selectExpr("doc_id", "text", "xxhash64(doc_id, text) as k").collect()}
    for i, t in rows:
        data, start = chunks._bytes(t), 0
        for end in chunks.chunk_ends(data):
            place.append(((i is not None, i or 0, keyed[i, t], start), (i, t), start, end, data[start:end]))
            start = end
    again = {}
    for _, row, start, end, piece in sorted(place, key=lambda x: x[0]):
        if piece in seen:
            again.setdefault(row, set()).add(start)
        seen.add(piece)
    for r in odd_rows:
        data, start, runs = chunks._bytes(r[1]), 0, []
        for end in chunks.chunk_ends(data):
            if start in again.get((r[0], r[1]), ()):
                if runs and runs[-1][1] == start:
                    runs[-1][1] = end
                else:
                    runs.append([start, end])
            start = end
        gone = {b for a, e in runs if e - a >= chunks.LEAST_RUN for b in range(a, e)}
        want.append((r[0], len(data), len(gone), hashlib.sha256(bytes(x for b, x in enumerate(data) if b not in gone)).hexdigest()))
    got = chunks.deduplicate_chunks(odd).select("doc_id", "n_bytes", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_chunks_fall_back_in_step():
    rng = random.Random(2)
    data = rng.randbytes(5000)
    moved = data[:100] + b"inserted" + data[100:]
    pieces = [{d[a:b] for a, b in zip([0, *e], e)} for d in (data, moved) for e in [chunks.chunk_ends(d)]]
    assert len(pieces[0] & pieces[1]) > 0.9 * len(pieces[0])
    h = chunks.gear_hashes(np.frombuffer(data, np.uint8))
    want = 0
    for b in data[:300]:
        want = ((want << 1) + int(chunks.GEAR[b])) & ((1 << 64) - 1)
    assert int(h[299]) == want


def test_planted_passages_and_short_copies_go(spark):
    """Passages of 51 to 60 words in two texts lose most of their bytes each, and exact copies of short texts go whole."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10)))
    say = lambda n: " ".join(word() for _ in range(n))
    rows, planted = [], {}
    for k in range(150):
        passage = say(rng.randrange(51, 61))
        planted[2 * k + 1] = len(passage)
        rows += [(2 * k, f"{say(80)} {passage} {say(80)}"), (2 * k + 1, f"{say(80)} {passage} {say(80)}")]
    short = {1000 + k: t for k, t in enumerate(["x", "a short line", say(5), "y" * 15, "z" * 63])}
    rows += [(i + d, t) for i, t in short.items() for d in (0, 500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    gone = {r["doc_id"]: r["n_removed"] for r in chunks.deduplicate_chunks(docs).select("doc_id", "n_removed").collect()}
    assert all(gone[i] > 0 for i in planted)
    assert sum(gone[i] for i in planted) > 0.6 * sum(planted.values())
    assert all(gone[i + 500] == len(t) for i, t in short.items())


def test_copies_leave_no_row_per_chunk(spark, monkeypatch):
    """What is written between the steps has a row per text at most, however many of its chunks other texts have too."""
    rng, tables, settled = random.Random(4), [], chunks.settled
    monkeypatch.setattr(chunks, "settled", lambda df: tables.append(settled(df)) or tables[-1])
    text = "".join(rng.choice("abcdefghij ") for _ in range(9000))
    rows = [(i, text if i % 5 else text[: 40 * i]) for i in range(1, 61)]
    got = chunks.deduplicate_chunks(spark.createDataFrame(rows, "doc_id bigint, text string"))
    out = {r["doc_id"]: (r["n_chunks"], r["n_repeated"], r["n_removed"]) for r in got.collect()}
    own = len(chunks.chunk_ends(text.encode()))
    assert own > 2 * chunks.BLOCK and out[1] == (own, 0, 0)
    assert all(out[i] == (own, own, 9000) for i, _ in rows if i % 5 and i > 1)
    assert all(out[i][1] >= out[i][0] - 1 for i in range(5, 61, 5))  # a text cut short has a last chunk of its own
    assert sum(t.count() for t in tables) <= len(rows)


def test_chunk_rows_of_several_batches(monkeypatch):
    rng = random.Random(6)
    texts = [None, "", "short", *("".join(rng.choice("ab\u00e9\u4f60 ") for _ in range(rng.randrange(3000))) for _ in range(20)), None]
    batch = pa.RecordBatch.from_pydict({"id": [None, *map(str, range(len(texts) - 1))], "key": [7 * k for k in range(len(texts))], "text": texts})
    want = []
    for i, key, t in zip(*(batch.column(c).to_pylist() for c in ("id", "key", "text"))):
        data, start = chunks._bytes(t), 0
        for n, end in enumerate(chunks.chunk_ends(data)):
            d = hashlib.blake2b(data[start:end], digest_size=16).digest()
            want.append((i, key, n, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
            start = end
    for most in (chunks.BATCH_CHUNKS, 50):
        monkeypatch.setattr(chunks, "BATCH_CHUNKS", most)
        out = list(chunks._digests(iter([batch])))
        assert (len(out) > 5) == (most == 50)
        assert [tuple(r.values()) for b in out for r in b.to_pylist()] == want
