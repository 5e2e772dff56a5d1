"""Loading, selection, filtering and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycard import settings
from tallycard.functions.select import any_of, begins, chosen, ends_in, having, pick, union_of_specs
from tallycard.functions.values import class_label
from tallycard.operators import clean, resample
from tallycard.operators.encode import patterns
from tallycard.operators.report import item_prevalence, joined_naturally
from tallycard.operators.cards import score_records, score_range, risk_of
from tallycard.registry.base import query, r6
from tallycard.session import scratch_path, settled
from tallycard.sources import loading, tables
from tallycard.sources.fixtures import (
    CARDS, COHORT_SQL, FLAGS, SCORED_SQL, STUDY_SQL, cohort, order_side, study, table,
)

# column specifications over the stand-in cohort, in the style of settings.PREDICTORS
SPECS = {
    "Dx": [begins("hx_")],
    "Dx+smoking": [having("smoking"), begins("hx_")],
    "Dx+gender": [having("gender"), begins("hx_")],
    "Dx+exposure": [any_of("any_tobacco_exposure", "no_such_column"), begins("hx_")],
}

ITEM_NAMES = {
    "hx_returned": "returned",
    "hx_deep_discount": "deep discount",
    "hx_bulk": "bulk",
    "hx_many": "many lines",
}

# prototype subjects over the stand-in flags: item -> positions that have it
PROTOTYPES = {
    "hx_returned": settings.PROTOTYPE_ITEMS["lung_hx_emphysema"],
    "hx_deep_discount": settings.PROTOTYPE_ITEMS["lung_hx_allergies"],
    "hx_bulk": settings.PROTOTYPE_ITEMS["lung_hx_copd"],
    "hx_high_tax": settings.PROTOTYPE_ITEMS["smoking_use_Current"],
    "hx_many": settings.PROTOTYPE_ITEMS["lung_hx_family_history_copd"],
}

PROTOTYPE_SQL = "prototypes(subject, hx_returned, hx_deep_discount, hx_bulk, hx_high_tax, hx_many) AS (VALUES " + ", ".join(
    "('{}', {})".format(s, ", ".join(str(int(i + 1 in PROTOTYPES[f])) for f in FLAGS))
    for i, s in enumerate(settings.PROTOTYPE_SUBJECTS)
) + ")"


def prototype_table(spark):
    rows = [
        (s, *[int(i + 1 in PROTOTYPES[f]) for f in FLAGS]) for i, s in enumerate(settings.PROTOTYPE_SUBJECTS)
    ]
    return spark.createDataFrame(rows, "subject string, " + ", ".join(f"{f} int" for f in FLAGS))


#: Lines of the raw file that are spoiled: a field too many, a price or a date that is none.
FAULTS = "o_orderkey % 61 = 0 AS extra, o_orderkey % 53 = 0 AS price, o_orderkey % 59 = 0 AS date"


def raw_cohort(spark, sf):
    """The orders as a raw CSV file, written and loaded again."""
    key = F.col("o_orderkey")
    spoiled = lambda n, bad, good: F.when(key % n == 0, bad).otherwise(good)
    o = table(spark, sf, "orders").select(
        key.alias("record_id"), F.col("o_orderstatus").alias("status"), spoiled(53, "on request", F.col("o_totalprice").cast("string")).alias("total"),
        spoiled(59, "31/31/1999", F.date_format(F.col("o_orderdate").cast("date"), "M/d/yyyy")).alias("ordered"))
    line = F.concat(F.concat_ws(",", *o.columns), F.when(F.col("record_id") % 61 == 0, ",more").otherwise(""))
    path = scratch_path(spark, "raw")
    # a header in every file, as a reader of many files expects
    o.select(line.alias(",".join(o.columns))).write.options(header=True, quote="", escape="", sep="\x01").csv(path)
    return loading.load_csv(spark, path, share=0.9)


@query("load_cohort", f"""
SELECT o_orderkey AS record_id, o_orderstatus AS status, o_totalprice AS total, CAST(o_orderdate AS DATE) AS ordered
FROM (SELECT *, {FAULTS} FROM orders) WHERE NOT (extra OR price OR date)""")
def load_cohort(spark, sf):
    return raw_cohort(spark, sf).rows


@query("load_rejected", f"""
WITH f AS (SELECT {FAULTS} FROM orders)
SELECT '' AS column, 'fields' AS reason, count(*) AS n FROM f WHERE extra HAVING count(*) > 0
UNION ALL SELECT 'total', 'double', count(*) FROM f WHERE price AND NOT extra HAVING count(*) > 0
UNION ALL SELECT 'ordered', 'date', count(*) FROM f WHERE date AND NOT extra HAVING count(*) > 0""")
def load_rejected(spark, sf):
    """Faults of the raw file by column and reason."""
    return raw_cohort(spark, sf).rejected.groupBy("column", "reason").agg(F.count("*").alias("n"))


@query("export_rounded", f"""
WITH {SCORED_SQL}
SELECT card, record_id, score, round(1 / (1 + exp(-(intercept + score) / multiplier)), 8) AS risk FROM scored""")
def export_rounded(spark, sf):
    scored = score_records(study(spark, sf), CARDS, ["record_id"])
    return tables.rounded(scored, ["risk"]).select("card", "record_id", "score", "risk")


@query("pending_cells", """
SELECT DISTINCT lang, source FROM documents
EXCEPT
SELECT DISTINCT d.lang, d.source FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1""")
def pending_cells(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    done = docs.join(table(spark, sf, "labels").filter("toxic = 1"), "doc_id")
    return tables.pending_cells(docs.select("lang", "source").distinct(), done, ["lang", "source"])


@query("complete_cells", """
WITH c AS (SELECT l_orderkey, count(*) AS count FROM lineitem GROUP BY l_orderkey)
SELECT l.l_orderkey, l.l_linenumber, c.count FROM lineitem l JOIN c ON l.l_orderkey = c.l_orderkey
WHERE c.count = (SELECT max(count) FROM c)""")
def complete_cells(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return tables.complete_cells(lines, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "count")


@query("prototypes", f"""
WITH {STUDY_SQL}, {PROTOTYPE_SQL}
SELECT p.*, count(s.record_id) AS n_alike, coalesce(sum(s.is_event::INT), 0)::BIGINT AS events_alike
FROM prototypes p LEFT JOIN study s ON p.hx_returned = s.hx_returned::INT AND p.hx_deep_discount = s.hx_deep_discount::INT
 AND p.hx_bulk = s.hx_bulk::INT AND p.hx_high_tax = s.hx_high_tax::INT AND p.hx_many = s.hx_many::INT
GROUP BY ALL""")
def prototypes(spark, sf):
    """Prototype subjects and how many records look just like them."""
    alike = patterns(study(spark, sf), FLAGS)
    alike = alike.withColumns({f: F.col(f).cast("int") for f in FLAGS})
    return prototype_table(spark).join(alike, FLAGS, "left").select(
        "subject", *FLAGS,
        F.coalesce("n", F.lit(0)).alias("n_alike"), F.coalesce("pos", F.lit(0)).alias("events_alike"))


@query("item_labels", f"""
WITH {STUDY_SQL}, u AS (UNPIVOT (SELECT hx_returned::INT AS hx_returned, hx_deep_discount::INT AS hx_deep_discount,
   hx_bulk::INT AS hx_bulk, hx_high_tax::INT AS hx_high_tax, hx_many::INT AS hx_many FROM study)
   ON hx_returned, hx_deep_discount, hx_bulk, hx_high_tax, hx_many INTO NAME item VALUE v)
SELECT item, CASE item WHEN 'hx_returned' THEN 'returned' WHEN 'hx_deep_discount' THEN 'deep discount'
  WHEN 'hx_bulk' THEN 'bulk' WHEN 'hx_many' THEN 'many lines' END AS label, sum(v)::BIGINT AS carriers
FROM u GROUP BY item""")
def item_labels(spark, sf):
    labels = spark.createDataFrame(list(ITEM_NAMES.items()), "item string, label string")
    counts = item_prevalence(study(spark, sf), FLAGS)
    return counts.join(F.broadcast(labels), "item", "left").select("item", "label", "carriers")


@query("select_spec", f"""
WITH {COHORT_SQL}
SELECT record_id, smoking_history_cigarette, hx_returned, hx_deep_discount, hx_bulk, hx_high_tax FROM cohort""")
def select_spec(spark, sf):
    return pick(cohort(spark, sf), SPECS["Dx+smoking"], drop=[ends_in("_many")], first=("record_id",))


@query("spec_union", f"""
WITH {COHORT_SQL}
SELECT unnest(['hx_returned', 'hx_deep_discount', 'hx_bulk', 'hx_high_tax', 'hx_many', 'smoking_history_cigarette', 'gender',
               'any_tobacco_exposure']) AS column_name,
       unnest([1, 2, 3, 4, 5, 6, 7, 8])::INT AS position,
       unnest([count(hx_returned), count(hx_deep_discount), count(hx_bulk), count(hx_high_tax), count(hx_many),
               count(smoking_history_cigarette), count(gender), count(any_tobacco_exposure)]) AS n_known
FROM cohort""")
def spec_union(spark, sf):
    df = cohort(spark, sf)
    names = union_of_specs(df.columns, SPECS)
    known = df.agg(*[F.count(c).alias(c) for c in names])
    return known.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"), F.col(c).alias("n_known"))
        for i, c in enumerate(names, 1)
    ])))


@query("infer_boolean_cols", f"""
WITH {COHORT_SQL}, words AS (
  SELECT CASE WHEN coalesce(hx_returned, false) THEN 'Checked' ELSE 'Unchecked' END AS box,
         CASE WHEN hx_many THEN 'Checked' WHEN NOT hx_many THEN 'Unchecked' END AS holed_box,
         CASE WHEN hx_bulk THEN 'Yes' WHEN NOT hx_bulk THEN 'No' END AS answer, gender FROM cohort),
t AS (
  SELECT 'box' AS column_name, sum((box = 'Checked')::INT)::BIGINT AS n_true, (count(*) - count(box))::BIGINT AS n_null,
         bool_and(coalesce(box IN ('Checked', 'Unchecked'), false)) AS ok FROM words
  UNION ALL SELECT 'holed_box', 0, 0, bool_and(coalesce(holed_box IN ('Checked', 'Unchecked'), false)) FROM words
  UNION ALL SELECT 'answer', sum((answer = 'Yes')::INT)::BIGINT, (count(*) - count(answer))::BIGINT,
         bool_and(coalesce(answer IN ('Yes', 'No'), true)) FROM words
  UNION ALL SELECT 'gender', 0, 0, bool_and(coalesce(gender IN ('Yes', 'No'), true)) FROM words)
SELECT column_name, n_true, n_null FROM t WHERE ok""")
def infer_boolean_cols(spark, sf):
    c = cohort(spark, sf)
    boxes = lambda f: F.when(F.col(f), "Checked").when(~F.col(f), "Unchecked")
    words = c.select(
        F.coalesce(boxes("hx_returned"), F.lit("Unchecked")).alias("box"),
        boxes("hx_many").alias("holed_box"),
        F.when(F.col("hx_bulk"), "Yes").when(~F.col("hx_bulk"), "No").alias("answer"),
        "gender",
    )
    found = clean.boolean_columns(words)
    typed = clean.typed_booleans(words, found)
    sums = typed.agg(*[
        F.struct(
            F.lit(n).alias("column_name"), F.sum(F.col(n).cast("long")).alias("n_true"),
            F.sum(F.col(n).isNull().cast("long")).alias("n_null")).alias(n)
        for n in found
    ])
    return sums.select(F.inline(F.array(*found)))


AGE_SQL = """
ages AS (
  SELECT *, year(date_received) - year(date_of_birth)
      - CASE WHEN CAST(date_of_birth + to_months(CAST(12 * (year(date_received) - year(date_of_birth)) AS INT)) AS DATE) > date_received
             THEN 1 ELSE 0 END AS k
  FROM cohort),
aged AS (
  SELECT * EXCLUDE (k),
    k + (date_received - CAST(date_of_birth + to_months(CAST(12 * k AS INT)) AS DATE))
      / (CAST(date_of_birth + to_months(CAST(12 * (k + 1) AS INT)) AS DATE)
         - CAST(date_of_birth + to_months(CAST(12 * k AS INT)) AS DATE))::DOUBLE AS age_years
  FROM ages)"""


@query("clean_dates", f"""
WITH {COHORT_SQL}, {AGE_SQL}, step1 AS (
  SELECT record_id, date_of_birth, age_calculated, (SELECT max(date_received) FROM cohort) AS last_received,
         CASE WHEN age_years < -0.75 THEN NULL ELSE date_received END AS date_received FROM aged)
SELECT record_id, date_received, age_calculated,
       CASE WHEN date_of_birth > last_received THEN NULL ELSE date_of_birth END AS date_of_birth
FROM step1""")
def clean_dates(spark, sf):
    # written once: the last receipt date and the rows both come from it
    dates = settled(cohort(spark, sf).select("record_id", "date_received", "age_calculated", "date_of_birth"))
    return clean.clean_dates(dates).select(
        "record_id", "date_received", "age_calculated", "date_of_birth")


@query("rename_rules", """
SELECT l_returnflag AS return_flag, count(*) AS lung_hx_copd,
       sum((l_discount >= 0.08::DOUBLE)::INT)::BIGINT AS liver_hx_cirrhosis FROM lineitem GROUP BY l_returnflag""")
def rename_rules(spark, sf):
    raw = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("Return Flag")).agg(
        F.count("*").alias("Lung Disease History (choice=COPD)"),
        F.sum((F.col("l_discount") >= 0.08).cast("int")).alias("Liver Disease History (choice=Cirrhosis)"))
    return clean.history_names(raw)


@query("complete_cases", f"""
WITH {COHORT_SQL}
SELECT genotype, count(*) AS n FROM cohort
WHERE hx_returned IS NOT NULL AND hx_bulk IS NOT NULL AND date_of_birth IS NOT NULL AND genotype IS NOT NULL
GROUP BY genotype""")
def complete_cases(spark, sf):
    c = cohort(spark, sf).select("genotype", "hx_returned", "hx_bulk", "date_of_birth")
    return c.dropna().groupBy("genotype").agg(F.count("*").alias("n"))


@query("drop_sentinel", f"""
WITH {COHORT_SQL}
SELECT gender, any_tobacco_exposure, count(*) AS n FROM cohort
WHERE gender <> '(Missing)' AND any_tobacco_exposure <> '(Missing)' GROUP BY ALL""")
def drop_sentinel(spark, sf):
    c = order_side(spark, sf)
    known = (F.col("gender") != "(Missing)") & (F.col("any_tobacco_exposure") != "(Missing)")
    return c.filter(known).groupBy("gender", "any_tobacco_exposure").agg(F.count("*").alias("n"))


@query("frequent_levels", """
SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY l_suppkey HAVING count(*) > 600""")
def frequent_levels(spark, sf):
    return clean.frequent_levels(table(spark, sf, "lineitem"), "l_suppkey", 600)


@query("label_response", f"""
WITH {COHORT_SQL}
SELECT genotype, CASE WHEN genotype = 'ZZ' THEN 'Abnormal' WHEN NOT genotype = 'ZZ' THEN 'Normal' END AS zz,
  CASE WHEN genotype IN ('SZ', 'ZZ') THEN 'Abnormal' WHEN NOT genotype IN ('SZ', 'ZZ') THEN 'Normal' END AS sz,
  CASE WHEN genotype <> 'MM' THEN 'Abnormal' WHEN genotype = 'MM' THEN 'Normal' END AS ab,
  count(*) AS n
FROM cohort GROUP BY ALL""")
def label_response(spark, sf):
    named = {k.lower(): class_label(t) for k, t in settings.responses().items()}
    labelled = order_side(spark, sf).withColumns(named)
    return labelled.groupBy("genotype", *named).agg(F.count("*").alias("n"))


@query("recode_category", """
SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN '(Missing)' WHEN c_mktsegment LIKE '%MACH%' THEN 'MACH'
            ELSE coalesce(c_mktsegment, '(Missing)') END AS segment, count(*) AS n
FROM customer GROUP BY 1""")
def recode_category(spark, sf):
    segment = clean.recode_category(F.col("c_mktsegment"), missing_code="BUILDING", part="MACH")
    return table(spark, sf, "customer").groupBy(segment.alias("segment")).agg(F.count("*").alias("n"))


SPLIT_SQL = f"""
strata AS (
  SELECT record_id, CASE WHEN genotype IN ('SZ', 'ZZ', 'MM') THEN genotype ELSE 'Ab' END AS stratum FROM cohort),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('{settings.SEED}|' || record_id), record_id) AS pos,
         count(*) OVER (PARTITION BY stratum) AS n FROM strata),
split AS (
  SELECT record_id, stratum, CASE WHEN pos <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM placed)"""


def split_table(spark, sf):
    strata = order_side(spark, sf).select("record_id", resample.genotype_stratum().alias("stratum"))
    return resample.split(strata, ["stratum"], "record_id", settings.TRAIN_FRACTION)


@query("semi_train", f"""
WITH {COHORT_SQL}, {SPLIT_SQL}
SELECT genotype, count(*) AS n, sum(n_lines)::BIGINT AS lines FROM cohort
WHERE record_id IN (SELECT record_id FROM split WHERE split = 'train') GROUP BY genotype""")
def semi_train(spark, sf):
    ids = split_table(spark, sf).filter("split = 'train'").select("record_id")
    kept = cohort(spark, sf).join(ids, "record_id", "left_semi")
    return kept.groupBy("genotype").agg(F.count("*").alias("n"), F.sum("n_lines").alias("lines"))


@query("semi_levels", f"""
WITH {COHORT_SQL}, incl AS (
  SELECT genotype FROM cohort WHERE genotype IS NOT NULL GROUP BY genotype HAVING count(*) > 1000)
SELECT genotype, gender, count(*) AS n FROM cohort WHERE genotype IN (SELECT genotype FROM incl) GROUP BY ALL""")
def semi_levels(spark, sf):
    c = order_side(spark, sf)
    included = settled(clean.frequent_levels(c, "genotype", 1000).select("genotype"))
    return c.join(included, "genotype", "left_semi").groupBy("genotype", "gender").agg(F.count("*").alias("n"))


@query("join_pred_resp", f"""
WITH {COHORT_SQL}
SELECT record_id, genotype, CASE WHEN genotype = 'ZZ' THEN 'Abnormal' ELSE 'Normal' END AS geno_class,
       hx_returned, hx_deep_discount, hx_bulk, hx_high_tax, hx_many
FROM cohort WHERE genotype IS NOT NULL AND hx_returned IS NOT NULL""")
def join_pred_resp(spark, sf):
    c = cohort(spark, sf)
    predictors = c.select("record_id", *FLAGS)
    included = clean.frequent_levels(order_side(spark, sf), "genotype", 0).select("genotype")
    cell = clean.analysis_table(
        predictors, order_side(spark, sf), chosen(c.columns, SPECS["Dx"]), included, settings.responses()["ZZ"])
    return cell.select("record_id", "genotype", "geno_class", *FLAGS)


def card_points(spark):
    rows = [(k, i, p, b0, m) for k, (b0, m, pts) in CARDS.items() for i, p in pts.items()]
    return spark.createDataFrame(rows, "card string, item string, points int, intercept double, multiplier double")


def card_risks(spark):
    """Every possible score of every card and its risk."""
    pts = card_points(spark)
    per_card = pts.select("card", "intercept", "multiplier").distinct()
    return score_range(pts, ["card"]).join(F.broadcast(per_card), "card").select(
        "card", "score", risk_of(F.col("score"), F.col("intercept"), F.col("multiplier")).alias("risk"))


RISK_SQL = """
risks AS (
  SELECT 'C0' AS card, unnest(range(0, 2))::INT AS score, -3.0 AS b0, 1.0 AS m
  UNION ALL SELECT 'C1', unnest(range(-2, 9))::INT, -3.0, 1.0
  UNION ALL SELECT 'C2', unnest(range(-1, 4))::INT, -3.0, 2.0),
card_risk AS (SELECT card, score, 1 / (1 + exp(-(b0 + score) / m)) AS risk FROM risks)"""


@query("score_to_risk", f"""
WITH {SCORED_SQL}, {RISK_SQL}
SELECT s.card, s.score, s.is_event, round(r.risk, 6) AS risk, count(*) AS n
FROM scored s LEFT JOIN card_risk r ON s.card = r.card AND s.score = r.score GROUP BY ALL""")
def score_to_risk(spark, sf):
    scored = score_records(study(spark, sf), CARDS, ["is_event"]).drop("risk")
    counts = scored.groupBy("card", "score", "is_event").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(card_risks(spark)), ["card", "score"], "left").withColumn("risk", r6("risk"))


@query("natural_left_join", f"""
WITH {SCORED_SQL}, {RISK_SQL}, c AS (SELECT card, score, count(*) AS n FROM scored GROUP BY ALL)
SELECT card, score, n, round(risk, 6) AS risk FROM c NATURAL LEFT JOIN card_risk""")
def natural_left_join(spark, sf):
    scored = score_records(study(spark, sf), CARDS, []).drop("risk")
    counts = scored.groupBy("card", "score").agg(F.count("*").alias("n"))
    return joined_naturally(counts, card_risks(spark)).withColumn("risk", r6("risk"))


