"""Nearest-value matches against a search row by row."""

import numpy as np
import pytest

from tallycard.operators.asof import asof_match, nearest


def brute(left, right, equal):
    out = []
    for g, v, i in left:
        own = [(w, j) for h, w, j in right if h == g and w is not None] if v is not None else []
        low = [x for x in own if (x[0] <= v if equal else x[0] < v)]
        high = [x for x in own if (x[0] >= v if equal else x[0] > v)]
        b = min((x for x in low if x[0] == max(low)[0]), default=None)
        a = min((x for x in high if x[0] == min(high)[0]), default=None)
        out.append((g, v, i, b, a))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 13])
@pytest.mark.parametrize("equal", [True, False])
def test_both_sides(spark, parts, equal):
    rng = np.random.default_rng(parts)
    groups = ["a", "b", None, "only left"]
    pick = lambda n, gs: [(gs[k], None if x > 0.97 else float(np.round(x * 40)), i) for i, (k, x) in enumerate(zip(rng.integers(0, len(gs), n), rng.random(n)))]
    left, right = pick(300, groups), pick(80, groups[:3] + ["only right"])
    left += [("a", 7.0, 900 + k) for k in range(200)]  # a frequent target
    schema = "g string, v double, i int"
    got = asof_match(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["g"], "v", ["i"], ["i"], equal, parts).collect()
    pair = lambda s: None if s is None else (s["v"], s["i"])
    assert sorted([(r["g"], r["v"], r["i"], pair(r["below"]), pair(r["above"])) for r in got], key=repr) == brute(left, right, equal)


def test_nearest_and_ties(spark):
    left = spark.createDataFrame([(1.0,), (2.0,), (5.0,), (9.0,), (None,)], "v double")
    right = spark.createDataFrame([(1.0, "x"), (3.0, "y"), (8.0, "z")], "v double, p string")
    found = asof_match(left, right, [], "v", ["p"], ["p"])
    of = lambda df: {r["v"]: r["nearest"] and r["nearest"]["p"] for r in df.collect()}
    assert of(nearest(found, "v")) == {1.0: "x", 2.0: "x", 5.0: "y", 9.0: "z", None: None}
    assert of(nearest(found, "v", upper=True))[2.0] == "y"


def test_empty_sides(spark):
    some, none = spark.createDataFrame([(1.0, "x")], "v double, p string"), spark.createDataFrame([], "v double, p string")
    assert asof_match(none, some, [], "v", ["p"], ["p"]).count() == 0
    assert asof_match(some, none, [], "v", ["p"], ["p"]).first()["below"] is None
