import itertools

import numpy as np
import pandas as pd
import planted
import pytest
from planted import EFFECTS, FEATURES, INTERCEPT
from pyspark.sql import functions as F

from tallycard.models import batch_fit, card_search, conditional, guideline, knn, lda, linear, svm, trees
from tallycard.models.linear import balanced_weights
from tallycard.operators import assoc
from tallycard.operators.encode import patterns, weighted_rows
from tallycard.operators.evaluate import roc_auc
from tallycard.registry import association  # noqa: F401
from tallycard.registry import base as base_registry
from tallycard.registry import fits as fits_registry
from tallycard.session import settled
from tallycard.sources.fixtures import FLAGS


@pytest.fixture(scope="module")
def pdf():
    return planted.flags()


@pytest.fixture(scope="module")
def df(spark, pdf):
    ints = pdf.astype({f: int for f in FEATURES})
    return settled(spark.createDataFrame(ints))


@pytest.fixture(scope="module")
def pats(df):
    return settled(patterns(df, FEATURES))


def area(pred):
    return roc_auc(pred, [], score="p_event", wide=False).first()[0]


def test_pattern_fit_equals_row_fit_and_recovers_effects(df, pats):
    by_pattern = linear.fit_logistic(weighted_rows(pats, FEATURES), FEATURES)
    by_row = linear.fit_logistic(df.withColumn("label", F.col("is_event").cast("double")), FEATURES, weight=None)
    newton = batch_fit.fit_many(pats, [batch_fit.FitSpec("x", tuple(FEATURES))])["x"]
    for f in FEATURES:
        assert by_pattern.coefs[f] == pytest.approx(by_row.coefs[f], abs=1e-4)
        assert newton.coefs[f] == pytest.approx(by_row.coefs[f], abs=1e-4)
        assert by_row.coefs[f] == pytest.approx(EFFECTS[f], abs=0.35)
    assert by_row.intercept == pytest.approx(INTERCEPT, abs=0.2)
    pred = linear.classed(df, ["is_event"], by_row.p_event())
    assert area(pred) > 0.7


def test_ridge_strength_means_the_same_in_all_fits(df, pats):
    for penalty in (1e-3, 0.1):
        lib = linear.fit_logistic(weighted_rows(pats, FEATURES), FEATURES, penalty)
        by_row = linear.fit_logistic(
            df.withColumn("label", F.col("is_event").cast("double")), FEATURES, penalty, weight=None)
        assert by_row.coefs == pytest.approx(lib.coefs, abs=1e-3)
        own = batch_fit.fit_many(pats, [batch_fit.FitSpec("x", tuple(FEATURES), penalty)])["x"]
        assert own.coefs == pytest.approx(lib.coefs, abs=1e-3)
        assert own.intercept == pytest.approx(lib.intercept, abs=1e-3)


def test_fold_left_out(df, pats):
    two = df.withColumn("fold", (F.col("record_id") % 2 + 1).cast("int"))
    by_fold = patterns(two, FEATURES, keys=["fold"])
    got = batch_fit.fit_many(by_fold, [batch_fit.FitSpec("x", tuple(FEATURES), 0.01, leave_out=1)])["x"]
    alone = patterns(two.filter("fold = 2"), FEATURES)
    want = batch_fit.fit_many(alone, [batch_fit.FitSpec("x", tuple(FEATURES), 0.01)])["x"]
    assert got.coefs == pytest.approx(want.coefs, abs=1e-8)


def test_losses(pats, pdf):
    fit = linear.LinearFit(-1.0, {"a": 1.0, "b": -0.5})
    p = 1 / (1 + np.exp(-(-1 + pdf.a - 0.5 * pdf.b)))
    want = -np.where(pdf.is_event, np.log(p), np.log(1 - p)).sum()
    assert batch_fit.losses(pats, {"k": fit})["k"] == pytest.approx(want)


def test_constant_and_separating_features_stay_finite(spark):
    rows = [(1, 0, 0, 5), (1, 1, 4, 4), (1, 0, 0, 1)]
    p = spark.createDataFrame(rows, "one int, s int, pos int, n int")
    fit = batch_fit.fit_many(p, [batch_fit.FitSpec("x", ("one", "s"))])["x"]
    assert np.isfinite([fit.intercept, *fit.coefs.values()]).all()


def test_lda_matches_closed_form(df, pdf):
    fit = lda.fit_lda(lda.lda_moments(df, FEATURES), FEATURES)
    x = pdf[FEATURES].to_numpy(float)
    e = pdf.is_event.to_numpy()
    m1, m0 = x[e].mean(0), x[~e].mean(0)
    s = ((x[e] - m1).T @ (x[e] - m1) + (x[~e] - m0).T @ (x[~e] - m0)) / (len(x) - 2)
    w = np.linalg.solve(s, m1 - m0)
    assert list(fit.coefs.values()) == pytest.approx(list(w))
    assert fit.intercept == pytest.approx(-0.5 * (m1 + m0) @ w + np.log(e.sum() / (~e).sum()))


def brute_knn(train, test, k, kernel):
    x, e = train[FEATURES].to_numpy(int), train.is_event.to_numpy(float)
    out = {}
    for row in test[FEATURES].drop_duplicates().to_numpy(int):
        d = np.abs(x - row).sum(1)
        shells = [(s, (d == s).sum(), e[d == s].mean()) for s in np.unique(d)]
        upto = np.cumsum([s[1] for s in shells])
        beyond = [s[0] for s, u in zip(shells, upto) if u >= k + 1]
        edge = beyond[0] if beyond else shells[-1][0] + 1
        left, num, den = k, 0.0, 0.0
        for s, n, share in shells:
            take = min(n, left)
            w = take * (1.0 if kernel == "rectangular" else 1 - s / (edge + 1e-6))
            num, den, left = num + w * share, den + w, left - take
        out[tuple(row)] = num / den
    return out


@pytest.mark.parametrize("kernel", ["rectangular", "triangular"])
@pytest.mark.parametrize("k", [1, 50, 4000, 10_000])
def test_neighbours_match_brute_force(spark, df, pdf, kernel, k):
    train, test = pdf[pdf.record_id % 3 > 0], pdf[pdf.record_id % 3 == 0]
    got = knn.knn_predict(
        patterns(df.filter("record_id % 3 > 0"), FEATURES), patterns(df.filter("record_id % 3 = 0"), FEATURES), FEATURES, k, kernel)
    want = brute_knn(train, test, k, kernel)
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        assert r.p_event == pytest.approx(want[tuple(r[f] for f in FEATURES)])


def test_neighbours_without_a_fold(df):
    f = df.withColumn("fold", (F.col("record_id") % 3 + 1).cast("int"))
    all_folds = knn.without_fold(knn.shells(patterns(f, FEATURES, keys=["fold"]), FEATURES, ["fold"]), 3)
    direct = knn.shells(patterns(f.filter("fold <> 2"), FEATURES), FEATURES, wanted=f)
    pick = lambda d: {(r.code, r.distance): (r.n, r.pos) for r in d.collect()}
    assert pick(all_folds.filter("fold = 2")) == pick(direct)


def test_tree_rules_partition_the_records(df, pats):
    model = trees.fit_tree(weighted_rows(pats, FEATURES), FEATURES, depth=3)
    rules = trees.rule_conditions(model, FEATURES)
    assert 2 <= len(rules) <= 8
    table = trees.rule_table(pats, rules).collect()
    assert sum(r.n for r in table) == df.count() and len(table) == len(rules)
    by_rule = {r.rule_id: r.p_event for r in table}
    pred = trees.predicted(model, pats.withColumn("rule", trees.rule_number(rules)), FEATURES, ["rule"])
    for r in pred.collect():
        assert r.p_event == pytest.approx(by_rule[r.rule])


def test_other_families_find_the_signal(df, pats):
    rows = weighted_rows(pats, FEATURES)
    labelled = df.withColumn("label", F.col("is_event").cast("double"))
    preds = [
        trees.predicted(trees.fit_tree(rows, FEATURES), df, FEATURES, ["is_event"]),
        trees.predicted(trees.fit_forest(labelled, FEATURES, 10, 2), df, FEATURES, ["is_event"]),
        svm.fit_svm_linear(rows, FEATURES).predict(df, ["is_event"]),
        svm.fit_svm_poly(rows, FEATURES, 2).predict(df, ["is_event"]),
        svm.fit_svm_poly(rows, FEATURES, 3).predict(df, ["is_event"]),
    ]
    for p in preds:
        assert area(p) > 0.7


@pytest.mark.parametrize("degree", [1, 2])
def test_svm_margin_has_the_least_hinge_loss(pats, degree):
    """The fitted margin against subgradient steps from it: no better weights near it, and far better than a constant margin."""
    rows = weighted_rows(pats, FEATURES)
    fit = svm.fit_svm_linear(rows, FEATURES) if degree == 1 else svm.fit_svm_poly(rows, FEATURES, degree)
    got = fit.with_margin(balanced_weights(rows)).select(*FEATURES, "label", "weight", "margin").toPandas()
    base = got[FEATURES].to_numpy(float)
    x = np.column_stack([base, *[base[:, a] * base[:, b] for a in range(len(FEATURES)) for b in range(a, len(FEATURES))]]) if degree == 2 else base
    y, w = np.where(got.label > 0.5, 1.0, -1.0), got.weight.to_numpy(float) / got.weight.sum()
    # LinearSVC penalises weights of features divided by their spread
    n = got.weight.sum()
    mean = w @ x
    spread = np.sqrt((w @ (x - mean) ** 2) * n / (n - 1))
    z = x / spread

    def loss(b):
        return w @ np.maximum(0, 1 - y * (z @ b[1:] + b[0])) + 0.1 / 2 * b[1:] @ b[1:]

    best = np.zeros(z.shape[1] + 1)
    least, b = loss(best), best.copy()
    for k in range(40_000):
        on = (y * (z @ b[1:] + b[0]) < 1) * w * y
        b = b - 2 / (k + 20) * np.concatenate([[-on.sum()], -(on @ z) + 0.1 * b[1:]])
        if loss(b) < least:
            least, best = loss(b), b.copy()
    design = np.column_stack([np.ones(len(z)), z])
    margin = got.margin.to_numpy(float)
    own = np.linalg.lstsq(design, margin, rcond=None)[0]
    assert np.allclose(design @ own, margin, atol=1e-6)  # the margin is one of the machine's form
    assert loss(own) < least + 0.005
    assert least < min(loss(np.eye(len(best))[0] * c) for c in np.linspace(-2, 2, 41)) - 0.05


def test_whole_results_of_the_fits(spark, small):
    """Shares of every test pattern and the correlation of every pair, not only sums over the training rows."""
    queries = base_registry.QUERIES
    for name in ("lr_pred", "svm_linear_pred", "svm_poly2_pred", "svm_poly3_pred"):
        got = queries[name](spark, small).toPandas()
        test = fits_registry.pattern_sets(spark, small)[1].toPandas()
        keep = [*FLAGS, "pos", "n"]
        assert sorted(map(tuple, got[keep].to_numpy().tolist())) == sorted(map(tuple, test[keep].to_numpy().tolist()))
        assert got.p_event.between(0, 1).all() and ((got.p_event >= 0.5) == (got.pred_class == "Abnormal")).all()
    rho = queries["latent_rho"](spark, small).toPandas()
    pairs = {tuple(r) for r in queries["latent_corr"](spark, small).select("i", "j").collect()}
    assert {tuple(r) for r in rho[["i", "j"]].to_numpy()} == pairs and rho.rho.between(-1, 1).all()


def test_guideline_shares(df):
    shares = {r.score: r.risk for r in guideline.rule_shares(df, F.col("a") == 1).collect()}
    assert shares[1] > shares[0]
    pred = guideline.rule_predictions(df, F.col("a") == 1, guideline.rule_shares(df, F.col("a") == 1), ["is_event"])
    assert {(r.score, r.pred_class) for r in pred.select("score", "pred_class").distinct().collect()} == {(0, "Normal"), (1, "Abnormal")}


def test_card_search_finds_the_best_small_cards(pats, pdf):
    found = card_search.card_search(pats, FEATURES, terms=2, bound=3, pool=3, beam=4, multipliers=12)
    assert [c.number for c in found] == [1, 2, 3]
    assert found[0].loss <= found[1].loss <= found[2].loss
    assert all(max(map(abs, c.points.values())) <= 3 and len(c.points) <= 2 for c in found)
    assert set(found[0].points) == {"a", "b"}
    assert len({tuple(sorted(c.points.items())) for c in found}) == 3
    # no two-item card on a fine grid of intercepts and multipliers is much better
    x, e = pdf[FEATURES].to_numpy(float), pdf.is_event.to_numpy()
    best = np.inf
    for i, j in itertools.combinations(range(5), 2):
        for p, q in itertools.product(range(-3, 4), repeat=2):
            for m in np.linspace(1, 3, 9):
                s = p * x[:, i] + q * x[:, j]
                for b0 in range(-8, 3):
                    eta = (b0 + s) / m
                    best = min(best, np.sum(np.logaddexp(0, eta) - e * eta))
    assert found[0].loss <= best * 1.01


def test_card_search_on_more_terms_than_features(pats):
    found = card_search.card_search(pats, FEATURES, terms=9, bound=6, pool=2, beam=3, multipliers=6)
    assert found and all(set(c.points) <= set(FEATURES) for c in found)


def test_two_stage_predictions(spark):
    p = planted.flags(3000)
    rng = np.random.default_rng(1)
    p["genotype"] = np.where(p.is_event, np.where(rng.random(len(p)) < 0.3 + 0.4 * p.c, "ZZ", "SZ"), "MM")
    p["age_guess"] = rng.random(len(p)) * 80
    p["smoking_history_cigarette"] = rng.choice(["None", "Past"], len(p))
    p["any_tobacco_exposure"] = rng.choice(["Yes", "No"], len(p))
    t = conditional.with_classes(spark.createDataFrame(p.drop(columns="is_event")))
    t = settled(t.withColumns({f: F.col(f).cast("int") for f in FEATURES}))
    shares = conditional.abnormal_shares(t).first()
    assert shares.p_zz + shares.p_sz == pytest.approx(1)
    out = conditional.two_stage(t, t.filter("abnormal"), FEATURES, ["record_id", "genotype"])
    assert {r.predictors for r in out.select("predictors").distinct().collect()} == set(conditional.STAGE_TWO)
    row = out.first()
    assert row.p_zz == pytest.approx(row.p_abnormal * row.p_zz_given_abnormal)
    zz = out.withColumn("is_event", F.col("genotype") == "ZZ")
    areas = roc_auc(zz, ["predictors"], score="p_zz_given_abnormal", wide=False).collect()
    assert all(a.roc_auc > 0.6 for a in areas)


def test_association_against_rows(spark):
    rng = np.random.default_rng(4)
    n, rho = 4000, 0.6
    z = rng.multivariate_normal([0, 0, 0], [[1, rho, 0], [rho, 1, 0], [0, 0, 1]], n)
    p = pd.DataFrame({"u": (z[:, 0] > 0.8).astype(int), "v": np.digitize(z[:, 1], [-0.5, 0.2, 1.1]), "w": (z[:, 2] > 0).astype(int)})
    tables = settled(assoc.pair_tables(spark.createDataFrame(p), ["u", "v", "w"]))
    got = {(r.i, r.j): r for r in assoc.kendall_phi(tables).collect()}
    for i, j in itertools.combinations("uvw", 2):
        a, b = p[i].to_numpy(), p[j].to_numpy()
        s = np.sign(a[:, None] - a[None, :]) * np.sign(b[:, None] - b[None, :])
        tau_a = s.sum() / (n * (n - 1))
        untied = lambda x: (np.sign(x[:, None] - x[None, :]) != 0).sum()
        assert got[(i, j)].tau_a == pytest.approx(tau_a)
        assert got[(i, j)].tau_b == pytest.approx(s.sum() / np.sqrt(untied(a) * float(untied(b))))
        assert got[(i, j)].phi == pytest.approx(np.corrcoef(a, b)[0, 1])
    latent = {(r.i, r.j): r.rho for r in assoc.latent_corr(tables).collect()}
    assert latent[("u", "v")] == pytest.approx(rho, abs=0.06)
    assert latent[("u", "w")] == pytest.approx(0, abs=0.08)
    eigen = assoc.matrix_eigen(assoc.full_matrix(assoc.latent_corr(tables), "rho")).toPandas()
    values = eigen.groupby("component").eigenvalue.first()
    assert values.sum() == pytest.approx(3) and values.is_monotonic_decreasing


def test_sets_exchange_features(spark):
    """Two features that only help together are found by exchange, where growing keeps one set."""
    rng = np.random.default_rng(2)
    n = 6000
    a, b = rng.integers(0, 2, n), rng.integers(0, 2, n)
    e = rng.random(n) < 1 / (1 + np.exp(-(-1.0 + 1.6 * a - 1.6 * b)))
    c = np.where(rng.random(n) < 0.12, 1 - (a & (1 - b)), a & (1 - b))  # a noisy copy of what a and b say together
    p = pd.DataFrame({"a": a, "b": b, "c": c, "d": rng.integers(0, 2, n), "is_event": e})
    pats = settled(patterns(spark.createDataFrame(p), list("abcd")))
    plain = {s: batch_fit.fit_many(pats, [batch_fit.FitSpec("s", s)])["s"] for s in itertools.combinations("abcd", 2)}
    loss = batch_fit.losses(pats, {"|".join(k): f for k, f in plain.items()})
    found = card_search.grown_sets(pats, list("abcd"), [2], beam=1)[2][0]
    assert "|".join(sorted(found.coefs)) == min(loss, key=loss.get)


def test_rounding_by_coordinate_beats_plain_rounding(pats):
    fit = batch_fit.fit_many(pats, [batch_fit.FitSpec("s", tuple(FEATURES))])["s"]
    w = np.array([fit.intercept, *fit.coefs.values()])
    for m in (0.7, 1.3, 2.1):
        plain = np.rint(w * m)
        (b0, points, _), = card_search.round_by_coordinate(pats, FEATURES, [(w * m, m, 9)])
        losses = batch_fit.matrix_losses(pats, FEATURES, np.array([plain / m, np.array([b0, *points]) / m]))
        assert losses[1] <= losses[0] + 1e-9


def test_search_of_no_records_and_of_a_constant_feature(spark):
    none = spark.createDataFrame([], "a int, b int, pos long, n long")
    assert all(len(c.points) <= 1 for c in card_search.card_search(none, ["a", "b"], 1, 3))
    flat = spark.createDataFrame([(1, 0, 3, 10), (1, 1, 6, 10)], "a int, b int, pos long, n long")
    assert card_search.card_search(flat, ["a", "b"], 2, 3)[0].points.get("b", 0) > 0
