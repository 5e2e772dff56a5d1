import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tallycard.llm import decontaminate


def _rows(passages):
    terms = pa.array([np.array(t, np.int32) for t, _ in passages], pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([terms, pa.array([np.array(w, np.float32) for _, w in passages], pa.list_(pa.float32()))], ["terms", "weights"])


def test_per_batch_steps_give_what_unique_gives_without_calling_it(monkeypatch):
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 50, 2000)
    want, count = np.unique(keys, return_counts=True)
    passages = [(rng.choice(30, n, replace=False).tolist(), rng.random(n).tolist()) for n in rng.integers(1, 8, 200)]
    brute: dict[tuple[int, int], float] = {}
    for t, w in passages:
        for a, x in zip(t, w):
            for b, y in zip(t, w):
                brute[a, b] = brute.get((a, b), 0.0) + float(np.float32(x)) * float(np.float32(y))
    items = decontaminate.Items([("1", "alpha beta gamma delta epsilon"), ("2", "beta gamma zeta eta theta iota")])
    texts = [decontaminate.terms("alpha beta gamma delta epsilon zeta " * 30), decontaminate.terms("nothing here at all"), []]

    # np.unique is a hundred times slower than a sort on these keys; the steps over all passages must not depend on it
    def refused(*args, **kwargs):
        raise AssertionError("np.unique on the per-batch path")

    monkeypatch.setattr(np, "unique", refused)
    got, times = decontaminate._distinct(keys)
    assert got.tolist() == want.tolist() and times.tolist() == count.tolist()
    # a batch cut out of a longer one, as its lists then start past the first value
    sums = pa.Table.from_batches(decontaminate._term_pairs(30, at_once=100)(iter([_rows(passages[:120]), _rows(passages).slice(120)]))).to_pandas()
    assert {(a, b): x for a, b, x in zip(sums["a"], sums["b"], sums["x"])} == pytest.approx(brute, rel=1e-12)
    df, stretches = items.frequencies(texts)
    assert stretches == 8 + 1 + 0 and df[items.vocabulary[b"alpha"]] == 8
    items.weigh(df, stretches)
    which, start, offsets, ids, vals = items.sparse(texts)
    assert which.tolist() == [0] * 7 and start.tolist() == list(range(0, 168, 24))
    assert np.allclose(np.add.reduceat(vals * vals, offsets), 1)


def test_latent_cosines_by_one_product_are_the_dense_ones():
    rng = np.random.default_rng(5)
    basis, wanted = rng.standard_normal((40, 6)).astype(np.float32), rng.standard_normal((3, 6)).astype(np.float32)
    offsets, ids, vals = np.array([0, 3, 4]), np.array([1, 7, 7, 39, 0, 2]), rng.random(6).astype(np.float32)
    dense = np.zeros((3, 40))
    for r, (a, b) in enumerate(zip(offsets, [3, 4, 6])):
        np.add.at(dense[r], ids[a:b], vals[a:b])
    placed = decontaminate._product(offsets, ids, vals, basis)
    assert np.allclose(placed, dense @ basis, atol=1e-5)
    assert basis[ids[0]].tolist() == basis.astype(np.float32)[1].tolist()  # the product leaves the basis as it was
