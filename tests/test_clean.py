import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallycard import settings
from tallycard.operators import clean, report
from tallycard.operators.encode import Encoder, constant_columns, levels_present, patterns, with_reference

D = dt.date


def dated(spark, rows):
    return spark.createDataFrame(rows, "id int, date_of_birth date, date_received date, age_calculated double")


def test_boolean_columns(spark):
    df = spark.createDataFrame(
        [("Checked", "Checked", "Yes", None, "Yes", 1), ("Unchecked", None, None, None, "maybe", 2)],
        "box string, holed string, answer string, empty string, mixed string, num int")
    found = clean.boolean_columns(df)
    assert found == {"box": "Checked", "answer": "Yes", "empty": "Yes"}
    typed = clean.typed_booleans(df, found).collect()
    assert [(r.box, r.answer, r.empty) for r in typed] == [(True, True, None), (False, None, None)]


def test_reversed_dates_blank_only_the_first_rule_that_fires(spark):
    df = dated(spark, [
        (1, D(2009, 1, 1), D(2005, 1, 1), 30.0), (2, D(1980, 1, 1), D(2006, 1, 1), None), (3, D(2015, 1, 1), None, 4.0)])
    strict = {r.id: r for r in clean.clean_dates(df).collect()}
    assert (strict[1].date_received, strict[1].date_of_birth, strict[1].age_calculated) == (None, None, 30.0)
    assert strict[2].date_received == D(2006, 1, 1) and strict[3].date_of_birth is None
    all_rules = {r.id: r for r in clean.clean_dates(df, F.lit("2030-01-01").cast("date"), strict=False).collect()}
    assert (all_rules[1].date_received, all_rules[1].date_of_birth, all_rules[1].age_calculated) == (None, None, None)
    assert all_rules[3].date_of_birth == D(2015, 1, 1)
    kept = {r.id: r for r in clean.clean_dates(df, F.lit("2030-01-01").cast("date")).collect()}
    assert kept[1].date_of_birth == D(2009, 1, 1)  # the receipt date was already blank


def test_age_classes_and_guesses(spark):
    df = dated(spark, [
        (1, D(2000, 1, 1), D(2001, 1, 1), 5.0), (2, D(2000, 1, 1), D(1999, 1, 1), None), (3, D(2000, 1, 1), D(1999, 7, 1), None),
        (4, D(2000, 2, 29), D(2001, 2, 28), None), (5, D(1999, 1, 1), None, None), (6, None, D(2001, 1, 1), None)])
    rows = {r.id: r for r in df.withColumns({"cls": clean.age_class(), "guess": clean.age_guess()}).collect()}
    assert [rows[i].cls for i in range(1, 7)] == [
        "already calculated", "implausible", "in utero?", "birth & receipt dates", "birth date only", "nothing"]
    assert [rows[i].guess for i in (1, 2, 4, 5, 6)] == [5.0, -1.0, 1.0, 10.0, None]


def test_threshold_count_is_excluded(spark):
    df = spark.range(120 + 121 + 200).select(
        F.when(F.col("id") < 120, "just").when(F.col("id") < 241, "more").alias("g"))
    assert [r.g for r in clean.frequent_levels(df, "g").collect()] == ["more"]


def test_recode_and_smoking(spark):
    df = spark.createDataFrame([("0", "Pipe"), ("An Allergist", "Past"), ("Other", "None"), (None, None)], "s string, h string")
    assert [r[0] for r in df.select(clean.recode_category(F.col("s"))).collect()] == ["(Missing)", "Allergist", "Other", "(Missing)"]
    from tallycard.functions.values import keep_levels

    h = df.withColumn("h", keep_levels(F.col("h"), settings.SMOKING_LEVELS))
    got = [(r.smoking_hx, r.smoking_use) for r in clean.with_smoking_classes(h, "h").collect()]
    assert got == [(None, None), (True, "Past"), (False, "Never"), (None, None)]


def test_guidelines_and_pack_years(spark):
    df = spark.createDataFrame([(False, None, False, True), (None, False, False, False)],
                               "lung_hx_copd boolean, lung_hx_emphysema boolean, lung_hx_chronic_bronchitis boolean, liver_hx_cirrhosis boolean")
    rows = clean.with_guidelines(df).collect()
    assert [(r.lung_hx_copd_emphysema_bronchitis, r.guidelines) for r in rows] == [(None, True), (None, None)]
    p = spark.createDataFrame([(2.0, 10.0, None, 3.0)], "packs_per_day_current double, for_how_many_years_current double, packs_per_day_past double, for_how_many_years_past double")
    r = clean.with_pack_years(p).first()
    assert (r.pack_years_current, r.pack_years_past) == (20.0, None)


def test_batches_are_right_closed(spark):
    rows = spark.createDataFrame([(0,), (1,), (5,), (6,), (9,), (10,)], "r int").select(clean.batch_label(F.col("r"), [5, 9])).collect()
    assert [r[0] for r in rows] == [None, "(0,5]", "(0,5]", "(5,9]", "(5,9]", "(9,Inf]"]


def test_encoder_learns_on_training_rows_only(spark):
    train = spark.createDataFrame([("b", True, 1, "x"), ("a", False, 1, "x"), (None, True, 1, "x")], "k string, t boolean, c int, z string")
    new = spark.createDataFrame([("zz", None, 5, "x"), (None, True, 1, "y")], "k string, t boolean, c int, z string")
    enc = Encoder(["k", "t", "c", "z"]).fit(train)
    assert enc.features == ["k_b", "t"]
    # a level that training has not seen is unknown, not the reference
    assert [tuple(r) for r in enc.transform(new).collect()] == [(None, None), (None, 1)]
    full = Encoder(["k"], full=True).fit(train)
    assert full.features == ["k_a", "k_b"]
    assert constant_columns(train, ["k", "t", "c", "z"]) == ["c", "z"]


def test_reference_level_and_level_limit(spark):
    assert with_reference(["Asian", "Black", "White"], settings.REFERENCE_RACE) == ["White", "Asian", "Black"]
    assert with_reference(["x"], "y") == ["x"]
    many = spark.range(1500).select(F.col("id").cast("string").alias("v"))
    with pytest.raises(ValueError):
        levels_present(many, "v", most=1000)
    assert len(levels_present(many, "v")) == 1500


def test_patterns_count_everything(spark):
    df = spark.createDataFrame([(1, 0, True), (1, 0, False), (0, 0, True)], "a int, b int, is_event boolean")
    got = {(r.a, r.b): (r.pos, r.n) for r in patterns(df, ["a", "b"]).collect()}
    assert got == {(1, 0): (1, 2), (0, 0): (1, 1)}


def test_report_helpers(spark):
    df = spark.createDataFrame([(1, 3.0), (1, None), (2, 30.0)], "g int, x double")
    assert {(r.bin, r.n) for r in report.histogram(df, "x", report.spread_width(df, "x")).collect()} == {(2, 1), (26, 1)}
    assert [r.x for r in report.sorted_nulls_last(df, ("x", True)).collect()] == [30.0, 3.0, None]
    counts = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "g string, n int")
    assert sorted(r.share for r in report.share_of_group(counts, ["g"]).collect()) == pytest.approx([0.25, 0.75, 1.0])
