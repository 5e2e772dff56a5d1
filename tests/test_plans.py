import planted
import pytest
from pyspark.sql import functions as F

from tallycard import settings
from tallycard.operators import resample
from tallycard.operators.clean import analysis_table
from tallycard.operators.evaluate import mean_interval
from tallycard.plans import final, preprocess, selection, tuning
from tallycard.session import settled


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("study")
    planted.raw_cohort().to_csv(out / "raw.csv", index=False)
    raw = spark.read.option("header", True).csv(str(out / "raw.csv"))
    raw = raw.withColumns({"Record ID": F.col("Record ID").cast("long"), "Age Calculated": F.col("Age Calculated").cast("double")})
    return preprocess.prepare(spark, raw, str(out))


def test_tables_have_the_right_columns(study):
    names = study.predictors.columns
    assert "lung_hx_copd" in names and "liver_hx_cirrhosis" in names and "smoking_use" in names
    assert not [n for n in names if n.endswith("_none") or n.startswith(("genotype", "aat_"))]
    assert "lung_hx_aat_deficiency_self" not in names and "liver_hx_liver_transplant" not in names
    assert set(study.responses.columns) == {"record_id", "genotype", "genotype_simple", "aat_level"}
    assert {r.genotype for r in study.included.collect()} == {"MM", "MZ", "SZ", "ZZ"}
    types = dict(study.predictors.dtypes)
    assert types["lung_hx_copd"] == "boolean" and types["date_of_birth"] == "date"
    reversed_pair = study.predictors.filter("record_id = 10").first()
    assert reversed_pair.date_received is None
    assert study.predictors.filter("smoking_use IS NULL").count() > 0  # the unlisted value


def test_split_covers_complete_records_once(study):
    audit = resample.split_audit(study.split, "record_id").first()
    assert audit.in_both == 0 and audit.listed_twice == 0
    assert study.split.join(study.predictors.filter("gender = '(Missing)'"), "record_id").count() == 0
    shares = study.split.groupBy("stratum").agg(F.avg((F.col("split") == "train").cast("int")).alias("p"), F.count("*").alias("n"))
    for r in shares.collect():
        assert r.p == pytest.approx(int(0.8 * r.n) / r.n)


def test_first_round_cell(study):
    ids = selection.subset_ids(study, share=0.8)
    test = settings.responses()["ZZ"]
    out = selection.run_cell(study, ids, settings.PREDICTORS["Dx+smoke use"], test, forest_trees=10, neighbors=60)
    metrics = out["metrics"].filter("metric = 'roc_auc'").toPandas().set_index("model").estimate
    assert len([m for m in metrics.index if not m.startswith("integer card")]) == 9
    assert {"integer card 1", "integer card 6"} <= set(metrics.index)
    assert metrics["logistic regression"] > 0.6 and metrics["integer card 1"] > 0.58
    counts = out["counts"].groupBy("model").agg(F.sum("n").alias("n")).toPandas()
    assert counts.n.nunique() == 1
    g = out["guideline"].first()
    assert 0 < g.sensitivity < 1 and g.recall == g.sensitivity


def test_first_round_is_stored_by_cell(spark, study, tmp_path):
    specs = {"Dx": settings.PREDICTORS["Dx"]}
    tests = {"ZZ": settings.responses()["ZZ"]}
    options = {"with_cards": False, "forest_trees": 3, "neighbors": 40, "share": 0.5}
    stored = selection.run_round(spark, study, str(tmp_path / "round"), specs, tests, **options)
    assert {name: stored[name].count() > 0 for name in selection.ROUND_SCHEMAS} == dict.fromkeys(selection.ROUND_SCHEMAS, True)
    assert stored["guideline"].count() == 1 and stored["metrics"].groupBy("model").count().count() == 9
    got = stored["predictions"]
    per_model = got.groupBy("predictors", "response", "model").count().collect()
    assert len(per_model) == 9 and len({r["count"] for r in per_model}) == 1
    assert got.select("record_id", "model").distinct().count() == got.count()


def test_second_round(spark, study):
    columns = [c for c in study.predictors.columns if c.startswith(("lung_", "liver_"))] + ["smoking_use"]
    ids = study.split.filter("split = 'train'").select("record_id")
    cell = analysis_table(study.predictors.join(ids, "record_id", "left_semi"), study.responses, columns, study.included,
                          settings.responses()["ZZ"])
    out = settled(tuning.run_cell(
        settled(cell), columns, v=3, penalties=[1e-4, 1e-2], neighbors=[10, 100], trees=[3], mtry=[2], terms=[2], bounds=[6],
        beam=3, multipliers=5))
    areas = out.filter("metric = 'roc_auc'").groupBy("model").count().collect()
    assert {r.model: r["count"] for r in areas} == {
        "logistic regression": 2 * 3, "nearest neighbors": 4 * 3, "random forest": 3, "integer card": 2 * 3}
    assert set(out.columns) == set(tuning.METRICS_SCHEMA.names) - {"predictors", "response"}
    summary = mean_interval(out.filter("metric = 'roc_auc'"), ["fold", "number"]).collect()
    ridge = [r for r in summary if r.model == "logistic regression"]
    assert len(ridge) == 2 and all(r.n == 3 and r["mean"] > 0.6 for r in ridge)
    assert [r.n for r in summary if r.model == "integer card"] == [6]


def test_final_round(spark, study):
    columns = [c for c in study.predictors.columns if c.startswith(("lung_", "liver_"))] + ["smoking_use"]
    cell = analysis_table(study.predictors, study.responses, columns, study.included, settings.responses()["ZZ"])
    both = settled(cell.join(study.split.select("record_id", "split"), "record_id"))
    rule = F.col("lung_hx_copd") | F.col("lung_hx_emphysema") | F.col("lung_hx_chronic_bronchitis") | F.col("liver_hx_cirrhosis")
    out = final.evaluate(
        spark, both.filter("split = 'train'"), both.filter("split = 'test'"), columns, rule, penalties=[1e-3], bounds=[6, 25],
        terms=[3], pool=2, beam=3, multipliers=6)
    models = {r.card for r in out.models.collect()}
    assert len(models) == 1 + 2 + 2
    assert out.points.filter("card <> 'guideline' AND abs(points) > 25").count() == 0
    n = both.filter("split = 'test'").count()
    assert out.predictions.count() == n * len(models)
    cut = {r.card: r for r in out.cutoffs.collect()}
    assert set(cut) <= models and "guideline" in cut
    best = out.metrics.filter("metric = 'roc_auc'").toPandas().set_index("card").estimate
    assert best[[c for c in best.index if c != "guideline"]].min() > 0.6
    assert out.risks.filter("risk IS NULL OR risk < 0 OR risk > 1").count() == 0
    # a score's risk in the lookup is the risk given to the records with that score
    odd = out.predictions.join(out.risks.withColumnRenamed("risk", "r"), ["card", "score"], "left").filter("abs(risk - r) > 1e-9 OR r IS NULL")
    assert odd.count() == 0
