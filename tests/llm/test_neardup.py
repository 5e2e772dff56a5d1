import random
import re

import numpy as np
import pytest

from tallycard.llm import neardup
from tallycard.llm.shingles import shingle_set


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in groups[root(i)] if x is not None]
        low = min(ids) if ids else None
        out.append((d, len(sets[i]), low, d == low))
    return out


def planted(rng):
    rows = []
    for g in range(25):
        base = [f"t{rng.randrange(5000)}" for _ in range(rng.choice([6, 12, 40, 90, 300]))]
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10 ** 6)}"
            if rng.random() < 0.3:
                words = words[rng.randrange(0, max(1, len(words) // 10)):]
            rows.append((len(rows) + 1000, " ".join(words)))
    return rows


@pytest.mark.parametrize("k,block,seed", [(4, 2000, 1), (5, 2000, 2), (4, 3, 3)])
def test_against_brute_force(spark, odd_rows, k, block, seed, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = [(r[0], r[1]) for r in odd_rows] + planted(random.Random(seed))
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id bigint, text string, cls string, bucket int, comp int").repartition(4)
    got = neardup.near_duplicates(docs, k=k).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows, k, 80), key=repr)


def test_keeps_one_with_all_columns(odd, none):
    out = neardup.keep_one(odd)
    assert out.columns == odd.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and 4 in ids and 5 in ids
    assert neardup.keep_one(none).count() == 0 and neardup.near_duplicates(none).count() == 0


def test_signature_is_the_sequential_one():
    """Against the elementwise definition: one element after another, with a register-wise minimum."""
    m, rng = 16, np.random.default_rng(3)
    for size in (1, 3, 40, 400):
        values = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        want = np.full(m, (1 << 64) - 1, dtype=object)
        for e in values:
            p = list(range(m))
            for j in range(m):
                r = neardup.mix(np.array([e], np.uint64) + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)))
                k = j + ((int(r[0]) & 0xFFFFFFFF) * (m - j) >> 32)
                p[j], p[k] = p[k], p[j]
                want[p[j]] = min(want[p[j]], j << 48 | int(neardup.mix(r)[0]) >> 16)
        assert neardup.superminhash([values], m)[0].tolist() == want.tolist()


def test_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
        b = np.concatenate([a[:889], rng.integers(0, 1 << 63, 111).astype(np.uint64)])  # similarity 0.8
        s = neardup.superminhash([np.unique(a), np.unique(b)])
        errors.append((s[0] == s[1]).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.04


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (103, 101), (102, 103)]
    got = {r["node"]: r["comp"] for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 104)}}


def test_shingles_lower_case_ascii_only():
    assert len(shingle_set("É a b c", 4)) == 1 and shingle_set("É a b c", 4)[0] != shingle_set("é a b c", 4)[0]
    assert shingle_set("A B C D", 4)[0] == shingle_set("a\tb\nc  d", 4)[0]
    assert len(shingle_set(None, 4)) == len(shingle_set(" \n", 4)) == 0
