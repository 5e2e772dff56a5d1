import hashlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallycard.operators import resample
from tallycard.operators.prefix import exact_quantiles, hash_positions, mark_first, numbered, running_totals
from tallycard.operators.clean import islands


def skewed(n=3000, seed=1):
    """A third of all rows share one value and one group."""
    rng = np.random.default_rng(seed)
    hot = rng.random(n) < 1 / 3
    return pd.DataFrame({
        "id": np.arange(n), "g": np.where(hot, "hot", rng.choice(["x", "y"], n)),
        "v": np.where(hot, 5.0, rng.lognormal(0, 3, n)),
    })


@pytest.mark.parametrize("descending", [False, True])
def test_wide_and_narrow_running_totals_agree(spark, descending):
    df = spark.createDataFrame(skewed()).groupBy("g", "v").agg(F.count("*").alias("n"))
    sort = lambda d: d.toPandas().sort_values(["g", "v"]).reset_index(drop=True)[["g", "v", "n", "cum_n", "tot_n"]]
    narrow = sort(running_totals(df, ["g"], "v", ["n"], descending))
    wide = sort(running_totals(df, ["g"], "v", ["n"], descending, wide=True, parts=16))
    pd.testing.assert_frame_equal(narrow, wide)
    assert narrow.groupby("g")["cum_n"].max().to_dict() == narrow.groupby("g")["n"].sum().to_dict()


def test_row_numbers_without_one_big_window(spark):
    ids = spark.createDataFrame([(int(i),) for i in np.random.default_rng(0).permutation(5000) * 3], "id bigint")
    got = numbered(ids, "id").toPandas().sort_values("id")
    assert got["row"].tolist() == list(range(1, 5001))


@pytest.mark.parametrize("wide", [False, True])
def test_quantiles_match_numpy(spark, wide):
    pdf = skewed()
    probs = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.9, "q4": 1.0}
    got = exact_quantiles(spark.createDataFrame(pdf), ["g"], "v", probs, wide=wide).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert got.loc[g].to_list() == pytest.approx([np.quantile(part["v"], p) for p in probs.values()])


def order(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i))


def test_positions_and_samples_match_plain_sorting(spark):
    pdf = skewed()
    df = spark.createDataFrame(pdf[["id", "g"]])
    placed = hash_positions(df, ["g"], "id", 11).toPandas()
    first = mark_first(df, ["g"], "id", 11, lambda n: F.floor(n * 0.3)).toPandas()
    assert len(first) == len(pdf)
    for g, part in pdf.groupby("g"):
        want = order(part["id"], 11)
        assert placed[placed.g == g].sort_values("position")["id"].tolist() == want
        assert set(first[(first.g == g) & first.picked]["id"]) == set(want[: int(len(want) * 0.3)])


def test_sample_sizes_at_the_ends(spark):
    df = spark.createDataFrame([(i, None if i < 4 else "k") for i in range(30)], "id int, g string")
    take = lambda rule: mark_first(df, ["g"], "id", 1, rule).filter("picked").count()
    assert take(lambda n: F.lit(0)) == 0
    assert take(lambda n: n) == 30
    assert take(lambda n: n + 5) == 30
    assert take(lambda n: F.lit(1)) == 2  # one per stratum, NULL included
    assert resample.sample_each(df, ["g"], "id", 6).count() == 4 + 6
    whole = resample.sample_fraction(df, "id", 0.5, seed=1)
    assert sorted(r.id for r in whole.collect()) == sorted(order(range(30), 1)[:15])
    assert resample.sample_fraction(df, "id", 0.0).count() == 0


@given(st.integers(1, 7), st.integers(0, 40), st.integers(1, 40))
@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
def test_folds_partition_each_stratum_evenly(spark, v, n_small, n_big):
    df = spark.createDataFrame([(i, i < n_small) for i in range(n_small + n_big)], "id int, event boolean")
    got = resample.folds(df, ["event"], "id", v).toPandas()
    assert len(got) == n_small + n_big
    for _, part in got.groupby("event"):
        sizes = part.groupby("fold").size().reindex(range(1, v + 1), fill_value=0)
        assert sizes.max() - sizes.min() <= 1


def test_split_is_stable_and_exact(spark):
    df = spark.createDataFrame(skewed()[["id", "g"]])
    a = resample.split(df, ["g"], "id", 0.8).toPandas()
    b = resample.split(df.repartition(13), ["g"], "id", 0.8).toPandas()
    assert dict(zip(a.id, a.split)) == dict(zip(b.id, b.split))
    for _, part in a.groupby("g"):
        assert (part.split == "train").sum() == int(len(part) * 0.8)
    audit = resample.split_audit(resample.split(df, ["g"], "id", 0.8), "id").first()
    assert audit["in_both"] == 0 and audit["listed_twice"] == 0 and audit["ids"] == 3000


def test_islands(spark):
    keys = [1, 2, 3, 7, 9, 10, 40]
    runs = islands(spark.createDataFrame([(k,) for k in keys], "k int"), "k").orderBy("island").collect()
    assert [(r.first_key, r.last_key, r.n_rows) for r in runs] == [(1, 3, 3), (7, 7, 1), (9, 10, 2), (40, 40, 1)]
