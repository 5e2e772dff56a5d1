import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallycard import session
from tallycard.plans.tuning import resume, resume_many, tuning_grid
from tallycard.sources import cells as cells_
from tallycard.sources import loading
from tallycard.sources import tables

SCHEMA = T.StructType([
    T.StructField("estimate", T.DoubleType()), T.StructField("predictors", T.StringType()), T.StructField("response", T.StringType())])


def test_csv_reading_and_writing(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("record_id,date_received,score\n1,02/29/2008,1.5\n2,99/99/2008,\n")
    schema = T.StructType([
        T.StructField("record_id", T.LongType()), T.StructField("date_received", T.DateType()), T.StructField("score", T.DoubleType())])
    rows = tables.read_cohort_csv(spark, str(tmp_path / "raw.csv"), schema).orderBy("record_id").collect()
    assert [(r.record_id, r.date_received, r.score) for r in rows] == [(1, dt.date(2008, 2, 29), 1.5), (2, None, None)]
    out = str(tmp_path / "out")
    tables.write_csv(spark.createDataFrame([(1, 0.1234567891)], "id int, p double"), out)
    assert spark.read.option("header", True).csv(out).first().p == "0.12345679"


def test_missing_table_is_empty(spark, tmp_path):
    got = tables.read_or_empty(spark, str(tmp_path / "none"), SCHEMA)
    assert got.count() == 0 and got.columns == SCHEMA.names


def test_a_grid_resumes_and_repeats_without_duplicates(spark, tmp_path):
    path = str(tmp_path / "grid")
    cells = [{"predictors": p, "response": r} for p in ("Dx", "Dx+gender") for r in ("ZZ", "Ab")]
    ran = []

    def run(cell):
        ran.append(tuple(cell.values()))
        if len(ran) == 3:
            raise RuntimeError("lost")
        return spark.createDataFrame([(0.5,), (0.7,)], "estimate double")

    with pytest.raises(RuntimeError):
        resume(spark, path, cells, SCHEMA, run)
    done = resume(spark, path, cells, SCHEMA, run)
    assert done.count() == 8 and len(ran) == 5 and len(set(ran)) == 4
    again = spark.createDataFrame([(0.9, "Dx", "ZZ")], "estimate double, predictors string, response string")
    cells_.publish({"results": again.select("estimate")}, path, {"predictors": "Dx", "response": "ZZ"})
    full = cells_.published(spark, path, "results", SCHEMA, ["predictors", "response"])
    assert full.count() == 7
    complete = tables.complete_cells(full, ["predictors", "response"])
    assert complete.count() == 6
    tables.check_complete(complete, ["predictors", "response"], 2)
    with pytest.raises(ValueError):
        tables.check_complete(full, ["predictors", "response"], 2)
    assert resume(spark, path, cells, SCHEMA, run).count() == 7


def test_grid_sizes(spark):
    folds = spark.range(1, 7).select(F.col("id").cast("int").alias("fold"))
    counts = {r.model: r["count"] for r in tuning_grid(folds, 15).groupBy("model").count().collect()}
    assert counts == {"logistic regression": 36, "random forest": 6 * 5 * 3, "nearest neighbors": 36, "integer card": 36}


def test_settled_tables_are_columnar_and_sized(spark):
    kept = session.settled(spark.range(100).withColumn("x", F.lit("y")))
    assert kept.count() == 100
    plan = kept.select("id")._jdf.queryExecution().optimizedPlan()
    assert int(str(plan.stats().sizeInBytes())) < 10_000
    assert "ReadSchema: struct<id:bigint>" in kept.select("id")._jdf.queryExecution().executedPlan().treeString()


def test_scratch_is_under_the_named_folder(spark):
    path = session.scratch_path(spark, "t")
    assert path.startswith(session.shared_dir(spark)) and path != session.scratch_path(spark, "t")


def test_a_cell_is_in_all_tables_or_in_none(spark, tmp_path, monkeypatch):
    path, names = str(tmp_path / "round"), ["predictors", "response"]
    cells = [{"predictors": "Dx", "response": r} for r in ("ZZ", "SZ")]
    schemas = {"first": "x int, predictors string, response string", "second": "y string, predictors string, response string"}
    ran = []

    def run(cell):
        ran.append(cell["response"])
        broken = F.raise_error("lost") if len(ran) == 2 else F.lit("y")
        return {"first": spark.range(3).select(F.col("id").cast("int").alias("x")), "second": spark.range(2).select(broken.cast("string").alias("y"))}

    with pytest.raises(Exception, match="lost"):  # between the two tables of the second cell
        resume_many(spark, path, cells, schemas, run)
    stored = tables.read_or_empty(spark, f"{path}/first", "x int, predictors string, response string, run string")
    assert stored.count() == 6  # three rows lie there unpublished
    seen = {t: cells_.published(spark, path, t, s, names) for t, s in schemas.items()}
    assert (seen["first"].count(), seen["second"].count()) == (3, 2)
    out = resume_many(spark, path, cells, schemas, run)
    assert (out["first"].count(), out["second"].count()) == (6, 4) and ran == [ran[0], ran[1], ran[1]]
    assert out["second"].columns == ["y", "predictors", "response"]


def test_tables_without_rows_are_published(spark, tmp_path):
    path = str(tmp_path / "round")
    cells_.publish({"a": spark.range(0).select(F.col("id").cast("int").alias("x"))}, path, {"cell": "c"})
    assert cells_.manifest(spark, path, ["cell"]).first()["rows"] == {"a": 0}
    assert cells_.published(spark, path, "a", "x int, cell string", ["cell"]).count() == 0


def test_load_with_rejected_rows(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("id,score,flag,born,note\n1,1.5,TRUE,3/4/1960,a\n2,,FALSE,12/31/1999,\"b, c\"\n3,x1,TRUE,3/4/1960,d\n4,2,maybe,31/12/1999,e\n"
                    "5,3,TRUE\n6,4,NA,1/1/2000,f\n7,5,TRUE,1/2/2000,g,h\n")
    loaded = loading.load_csv(spark, str(path), share=0.6)
    assert dict(loaded.rows.dtypes) == {"id": "bigint", "score": "double", "flag": "boolean", "born": "date", "note": "string"}
    assert {r["id"]: (r["score"], r["flag"], str(r["born"]), r["note"]) for r in loaded.rows.collect()} == {
        1: (1.5, True, "1960-03-04", "a"), 2: (None, False, "1999-12-31", "b, c"), 6: (4.0, None, "2000-01-01", "f")}
    found = sorted((r["column"], r["reason"], r["value"]) for r in loaded.rejected.collect())
    assert found == [("", "fields", "5,3,TRUE"), ("", "fields", "7,5,TRUE,1/2/2000,g,h"), ("born", "date", "31/12/1999"), ("flag", "boolean", "maybe"), ("score", "double", "x1")]


def test_load_with_given_types_and_no_rows(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("id,score\n")
    loaded = loading.load_csv(spark, str(path), types={"id": "bigint", "score": "double"})
    assert loaded.rows.count() == 0 and loaded.rejected.count() == 0 and dict(loaded.rows.dtypes) == {"id": "bigint", "score": "double"}
    path.write_text("id,score\n1,2\n1.5,3\n")
    loaded = loading.load_csv(spark, str(path), types={"id": "bigint", "score": "double"})
    assert [tuple(r) for r in loaded.rows.collect()] == [(1, 2.0)]
    assert [(r["column"], r["value"]) for r in loaded.rejected.collect()] == [("id", "1.5")]
