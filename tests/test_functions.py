import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallycard import settings
from tallycard.functions.dates import calendar_years, parse_date
from tallycard.functions.select import (
    all_of, any_of, begins, chosen, ends_in, everything, having, pick, renamed, replacing, snake_case, union_of_specs,
    without,
)
from tallycard.functions.values import (
    class_label, if_else, is_one_of, joined_text, keep_levels, level_number, number_text, percent_text, replace_first,
    setting_text, sign_change,
)

NAMES = ["record_id", "gender", "lung_hx_copd", "lung_hx_none", "liver_hx_jaundice", "smoking_hx", "smoking_use"]


def test_selection_keeps_order_and_drops_repeats():
    assert chosen(NAMES, settings.PREDICTORS["Dx+smoke hx"], settings.NOT_PREDICTORS) == [
        "smoking_hx", "lung_hx_copd", "liver_hx_jaundice"]
    assert chosen(NAMES, [having("hx"), everything()])[:2] == ["lung_hx_copd", "lung_hx_none"]
    assert chosen(NAMES, [any_of("nope", "gender")]) == ["gender"]
    with pytest.raises(KeyError):
        chosen(NAMES, [all_of("nope")])
    assert union_of_specs(NAMES, settings.PREDICTORS) == [
        "lung_hx_copd", "lung_hx_none", "liver_hx_jaundice", "smoking_hx", "smoking_use", "gender"]


def test_pick_without_rename(spark):
    df = spark.createDataFrame([tuple(range(7))], NAMES)
    assert pick(df, [begins("lung_")], [ends_in("_none")], first=("record_id",)).columns == ["record_id", "lung_hx_copd"]
    assert without(df, begins("l"), having("smoking")).columns == ["record_id", "gender"]
    assert renamed(df, replacing("hx", "dx"), [begins("lung")]).columns[2:5] == [
        "lung_dx_copd", "lung_dx_none", "liver_hx_jaundice"]


@pytest.mark.parametrize("raw,clean", [
    ("Date of Birth", "date_of_birth"), ("alpha-1 Brochure", "alpha_1_brochure"), ("packsPerDay", "packs_per_day"),
    ("Lung Disease History (choice=COPD)", "lung_disease_history_choice_copd"),
])
def test_snake_case(raw, clean):
    assert snake_case(raw) == clean


@pytest.mark.parametrize("start,end,years", [
    ("2000-01-01", "2001-01-01", 1.0),
    ("2000-02-29", "2001-02-28", 1.0),
    ("2000-02-29", "2000-03-01", 1 / 365),
    ("2001-03-01", "2001-03-01", 0.0),
    ("1999-03-01", "2000-02-29", 365 / 366),
    ("2001-01-01", "2000-01-01", -1.0),
    ("2001-01-01", "2000-07-02", -183 / 366),
])
def test_calendar_years(spark, start, end, years):
    days = spark.createDataFrame([(dt.date.fromisoformat(start), dt.date.fromisoformat(end))], "s date, e date")
    assert days.select(calendar_years(F.col("s"), F.col("e"))).first()[0] == pytest.approx(years)


def test_missing_values_follow_three_valued_logic(spark):
    df = spark.createDataFrame([(True, "a"), (False, None), (None, "b")], "t boolean, s string")
    rows = df.select(
        if_else(F.col("t"), F.lit(1), F.lit(0)), class_label(F.col("t")), is_one_of(F.col("s"), ["a"]),
        sign_change(F.col("t")), keep_levels(F.col("s"), ["a"]), level_number(F.col("s"), ["b", "a"]),
    ).collect()
    assert [tuple(r) for r in rows] == [
        (1, "Abnormal", True, 1, "a", 2), (0, "Normal", False, -1, None, None), (None, None, False, None, None, 1)]


def test_texts(spark):
    df = spark.createDataFrame([(0.12345, -3, "banana", None)], "p double, i int, s string, z string")
    row = df.select(
        percent_text(F.col("p"), 2), number_text(F.col("i")), replace_first(F.col("s"), "an", "X"),
        joined_text(" -> ", F.col("s"), F.col("z")), setting_text(terms=F.col("i"), bound=F.col("z"))).first()
    assert tuple(row) == ("12.35%", "–3", "bXana", "banana -> NA", "terms = -3")
    bad = spark.createDataFrame([("02/29/2000",), ("13/45/2000",), (None,), ("2/9/2008",)], "d string")
    assert [r[0] for r in bad.select(parse_date(F.col("d"))).collect()] == [
        dt.date(2000, 2, 29), None, None, dt.date(2008, 2, 9)]
