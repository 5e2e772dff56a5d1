"""From the raw record table to analysis tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycard import settings
from tallycard.functions.dates import calendar_years, parse_date
from tallycard.functions.select import begins, ends_in, pick, renamed, replacing, snake_case, without
from tallycard.functions.values import if_else, keep_levels
from tallycard.operators.prefix import numbered, running_totals, values_at
from tallycard.session import settled

YES_NO = [({"Checked", "Unchecked"}, "Checked", False), ({"Yes", "No"}, "Yes", True)]


def boolean_columns(df: DataFrame, candidates: list[str] | None = None) -> dict[str, str]:
    """Text columns that hold only a yes/no vocabulary -> the word for yes.

    One aggregate pass over all columns. NULLs are allowed for Yes/No but not
    for Checked/Unchecked, and an all-NULL column counts as Yes/No.
    """
    names = candidates or [n for n, t in df.dtypes if t == "string"]
    flags = []
    for i, (words, _, nulls) in enumerate(YES_NO):
        for n in names:
            inside = F.coalesce(F.col(n).isin(sorted(words)), F.lit(nulls))
            flags.append(F.bool_and(inside).alias(f"{i}|{n}"))
    row = df.agg(*flags).first()
    found: dict[str, str] = {}
    for i, (_, yes, _) in enumerate(YES_NO):
        for n in names:
            if row[f"{i}|{n}"] and n not in found:
                found[n] = yes
    return found


def typed_booleans(df: DataFrame, yes_words: dict[str, str]) -> DataFrame:
    return df.withColumns({n: F.col(n) == yes for n, yes in yes_words.items()})


def typed_dates(df: DataFrame, pattern: str = "M/d/yyyy") -> DataFrame:
    """Parse every text column with 'date' in its name; unparsable text is NULL."""
    return df.withColumns({n: parse_date(F.col(n), pattern) for n, t in df.dtypes if "date" in n and t == "string"})


def history_names(df: DataFrame) -> DataFrame:
    """Snake-case names and shorter prefixes for the history check boxes."""
    df = renamed(df, snake_case)
    df = renamed(df, replacing("liver_disease_history_choice", "liver_hx"))
    return renamed(df, replacing("lung_disease_history_choice", "lung_hx"))


def recode_category(value: Column, missing_code: str = "0", part: str = "Allergist") -> Column:
    """Code for missing -> NULL, anything containing ``part`` -> ``part``, NULL -> '(Missing)'."""
    recoded = F.when(value == missing_code, None).when(value.contains(part), part).otherwise(value)
    return F.coalesce(recoded, F.lit("(Missing)"))


def frequent_levels(df: DataFrame, column: str, more_than: int = settings.MIN_LEVEL_COUNT) -> DataFrame:
    """Non-missing values of ``column`` that occur more than ``more_than`` times."""
    return df.groupBy(column).agg(F.count("*").alias("n")).filter(F.col("n") > more_than).dropna(subset=[column])


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of NULLs per column, one row per column, one pass."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return rates.unpivot([], columns, "variable", "missing_share")


def age_years() -> Column:
    return calendar_years(F.col("date_of_birth"), F.col("date_received"))


def age_class() -> Column:
    """Which information about age a record has."""
    both = F.col("date_of_birth").isNotNull() & F.col("date_received").isNotNull()
    return (
        F.when(F.col("age_calculated").isNotNull(), "already calculated")
        .when(both & (age_years() < settings.EARLIEST_PLAUSIBLE_AGE), "implausible")
        .when(both & (age_years() <= 0), "in utero?")
        .when(both, "birth & receipt dates")
        .when(F.col("date_of_birth").isNotNull(), "birth date only")
        .otherwise("nothing")
    )


def age_guess() -> Column:
    """Recorded age, else age at receipt, else age at the reference date."""
    at_reference = calendar_years(F.col("date_of_birth"), F.to_date(F.lit(settings.REFERENCE_DATE)))
    return F.coalesce(F.col("age_calculated"), age_years(), at_reference)


def clean_dates(df: DataFrame, latest_birth: Column | None = None, strict: bool = True) -> DataFrame:
    """Blank implausible dates and ages.

    ``strict`` keeps the original order of steps: once the receipt date of a
    reversed pair is blank, the later tests of that pair see NULL and do not
    fire. Otherwise every rule looks at the raw values. ``latest_birth``
    defaults to the last receipt date in the table.
    """
    if latest_birth is None:
        latest_birth = df.agg(F.max("date_received")).scalar()
    early = lambda: F.coalesce(age_years() < settings.EARLIEST_PLAUSIBLE_AGE, F.lit(False))
    if not strict:
        df = df.withColumn("_early", early())
        early = lambda: F.col("_early")
    df = df.withColumn("date_received", F.when(early(), None).otherwise(F.col("date_received")))
    late = F.coalesce(F.col("date_of_birth") > latest_birth, F.lit(False))
    df = df.withColumn("date_of_birth", F.when(late | early(), None).otherwise(F.col("date_of_birth")))
    df = df.withColumn("age_calculated", F.when(early(), None).otherwise(F.col("age_calculated")))
    return df.drop("_early")


def with_smoking_classes(df: DataFrame, history: str = "smoking_history_cigarette") -> DataFrame:
    """smoking_hx: ever smoked; smoking_use: Never, Past or Current. NULL stays NULL."""
    ever = F.col(history).isin("Past", "Current")
    return df.withColumn("smoking_hx", ever).withColumn(
        "smoking_use", if_else(F.col("smoking_hx"), F.col(history), F.lit("Never")))


def with_pack_years(df: DataFrame, kinds: tuple[str, ...] = ("current", "past")) -> DataFrame:
    return df.withColumns({
        f"pack_years_{k}": F.col(f"packs_per_day_{k}") * F.col(f"for_how_many_years_{k}") for k in kinds
    })


def with_guidelines(df: DataFrame) -> DataFrame:
    """Chronic obstructive disease in any of its three forms; with cirrhosis added."""
    df = df.withColumn(
        "lung_hx_copd_emphysema_bronchitis",
        F.col("lung_hx_copd") | F.col("lung_hx_emphysema") | F.col("lung_hx_chronic_bronchitis"))
    return df.withColumn(
        "guidelines", F.col("lung_hx_copd_emphysema_bronchitis") | F.col("liver_hx_cirrhosis"))


def predictor_table(raw: DataFrame) -> DataFrame:
    """Cleaned predictors of a typed raw table; responses and leaks dropped."""
    df = without(raw, begins("genotype"), begins("aat_"))
    df = clean_dates(df)
    df = without(df, ends_in("_none")).drop("lung_hx_aat_deficiency_self", "liver_hx_liver_transplant")
    df = df.withColumn(
        "smoking_history_cigarette", keep_levels(F.col("smoking_history_cigarette"), settings.SMOKING_LEVELS))
    df = with_smoking_classes(df)
    df = without(df, begins("packs_per_day"), begins("for_how_many_years"))
    return df.drop("patient_received_what_is_alpha_1_brochure", "physician_address_zipcode")


def response_table(raw: DataFrame, predictors: DataFrame) -> DataFrame:
    wanted = pick(raw, [begins("genotype"), begins("aat_")], first=("record_id",))
    return wanted.join(predictors.select("record_id"), "record_id", "left_semi")


def islands(df: DataFrame, key: str) -> DataFrame:
    """Runs of consecutive keys: first, last, length, and number of the run.

    ``key`` is a unique whole number. The rows of a run share key minus
    position, so a run of any length is a partial aggregate; the run's rows are
    every key from first to last.
    """
    placed = numbered(df.select(F.col(key).cast("long").alias("key")), "key", "position")
    runs = placed.groupBy((F.col("key") - F.col("position")).alias("offset")).agg(
        F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("n_rows"))
    return numbered(runs.drop("offset"), "first_key", "island")


def batch_label(row: Column, cuts: list[float]) -> Column:
    """Right-closed batches (lo, hi] of a row number; the last one is open."""
    edges = [0, *cuts]
    label = None
    for lo, hi in zip(edges, cuts):
        step = (row > lo) & (row <= hi)
        text = f"({lo},{hi}]"
        label = F.when(step, text) if label is None else label.when(step, text)
    return label.when(row > edges[-1], f"({edges[-1]},Inf]")


def in_batches(df: DataFrame, key: str, cuts: list[int], name: str = "batch") -> DataFrame:
    """Batches (lo, hi] of the rows' positions in the order of a unique column, without numbering the rows.

    The keys at the cuts are looked up, and each row is compared with them. A cut
    beyond the last row leaves its batches empty.
    """
    found = {r["position"]: r["value"] for r in values_at(df, key, cuts).collect()}  # one row per cut
    edges = [0, *cuts]
    label = F.lit(f"({edges[-1]},Inf]")
    for lo, hi in reversed(list(zip(edges, cuts))):
        inside = F.lit(True) if hi not in found else F.col(key) <= F.lit(found[hi])
        label = F.when(inside, f"({lo},{hi}]").otherwise(label)
    return df.withColumn(name, label)


def first_seen_order(df: DataFrame, level: str, position: str) -> DataFrame:
    """Levels of a (small) vocabulary numbered in order of first appearance."""
    firsts = df.groupBy(level).agg(F.min(position).alias("first_at")).withColumn("_one", F.lit(1))
    ran = running_totals(firsts, [], "first_at", ["_one"])
    return ran.select(level, "first_at", F.col("cum__one").cast("int").alias("level_no"))


def label_response(df: DataFrame, test: Column, name: str = "geno_class") -> DataFrame:
    """Class label of a boolean test; records with an unknown answer are dropped."""
    return df.withColumn(name, if_else(test, F.lit("Abnormal"), F.lit("Normal"))).dropna(subset=[name])


def analysis_table(predictors: DataFrame, responses: DataFrame, columns: list[str], included: DataFrame,
                   test: Column) -> DataFrame:
    """One experiment cell: chosen predictors, complete, joined to the labelled response."""
    left = predictors.select("record_id", *columns).dropna()
    # settled, so that the few levels are seen to be few and the table is not shuffled by a key of five values
    right = responses.select("record_id", "genotype").join(settled(included), "genotype", "left_semi")
    return label_response(right, test).join(left, "record_id").withColumn(
        "is_event", F.col("geno_class") == "Abnormal")


