"""Association among predictors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallycard import settings
from tallycard.functions.values import level_number
from tallycard.operators import assoc, rank_assoc
from tallycard.registry.base import query, r6
from tallycard.registry.tables import ITEM_NAMES
from tallycard.sources.fixtures import COHORT_SQL, FLAGS, cohort

ITEMS = [*FLAGS, "smoking"]

PAIR_SQL = COHORT_SQL + """,
coded AS (SELECT hx_returned::INT AS hx_returned, hx_deep_discount::INT AS hx_deep_discount, hx_bulk::INT AS hx_bulk, hx_high_tax::INT AS hx_high_tax,
  hx_many::INT AS hx_many, CASE smoking_history_cigarette WHEN 'None' THEN 1 WHEN 'Passive Smoke as a Child' THEN 2
  WHEN 'Passive Smoke as am Adult' THEN 3 WHEN 'Past' THEN 4 WHEN 'Current' THEN 5 END AS smoking FROM cohort WHERE hx_returned IS NOT NULL),
pairs AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS i, '{b}' AS j, {a}::INT AS vi, {b}::INT AS vj, count(*) AS n FROM coded GROUP BY ALL"
    for x, a in enumerate(ITEMS) for b in ITEMS[x + 1:]) + ")"

TAU_SQL = PAIR_SQL + """,
tot AS (SELECT i, j, sum(n)::DOUBLE AS n, sum(n * vi)::DOUBLE AS x, sum(n * vj)::DOUBLE AS y, sum(n * vi * vi)::DOUBLE AS xx,
  sum(n * vj * vj)::DOUBLE AS yy, sum(n * vi * vj)::DOUBLE AS xy FROM pairs GROUP BY ALL),
s AS (SELECT a.i, a.j, sum(CASE WHEN b.vi < a.vi AND b.vj < a.vj THEN a.n * b.n WHEN b.vi < a.vi AND b.vj > a.vj THEN -a.n * b.n ELSE 0 END)::DOUBLE AS s
  FROM pairs a JOIN pairs b ON a.i = b.i AND a.j = b.j GROUP BY ALL),
ti AS (SELECT i, j, sum(m * (m - 1) / 2)::DOUBLE AS t FROM (SELECT i, j, vi, sum(n)::DOUBLE AS m FROM pairs GROUP BY ALL) GROUP BY ALL),
tj AS (SELECT i, j, sum(m * (m - 1) / 2)::DOUBLE AS t FROM (SELECT i, j, vj, sum(n)::DOUBLE AS m FROM pairs GROUP BY ALL) GROUP BY ALL),
tau AS (SELECT tot.i, tot.j, n, s / (n * (n - 1) / 2) AS tau_a, s / sqrt((n * (n - 1) / 2 - ti.t) * (n * (n - 1) / 2 - tj.t)) AS tau_b,
  (n * xy - x * y) / sqrt((n * xx - x * x) * (n * yy - y * y)) AS phi
  FROM tot JOIN s USING (i, j) JOIN ti USING (i, j) JOIN tj USING (i, j))"""


def tables(spark, sf):
    smoking = level_number(F.col("smoking_history_cigarette"), settings.SMOKING_LEVELS)
    return assoc.pair_tables(cohort(spark, sf).withColumn("smoking", smoking), ITEMS)


@query("assoc_types", f"""
WITH {COHORT_SQL}
SELECT unnest(['hx_bulk', 'smoking_history_cigarette', 'age_calculated']) AS column_name, unnest(['bin', 'ter', 'con']) AS type,
  unnest([count(hx_bulk), count(smoking_history_cigarette), count(age_calculated)]) AS n_known FROM cohort""")
def assoc_types(spark, sf):
    return assoc.column_types(cohort(spark, sf), ["hx_bulk", "smoking_history_cigarette", "age_calculated"])


@query("pair_tables", f"WITH {PAIR_SQL} SELECT * FROM pairs")
def pair_tables(spark, sf):
    return tables(spark, sf)


@query("kendall_phi", f"""
WITH {TAU_SQL} SELECT i, j, n::BIGINT AS n, round(tau_a, 6) AS tau_a, round(tau_b, 6) AS tau_b, round(phi, 6) AS phi FROM tau""")
def kendall_phi(spark, sf):
    t = assoc.kendall_phi(tables(spark, sf))
    return t.select("i", "j", "n", *[r6(c).alias(c) for c in ("tau_a", "tau_b", "phi")])


@query("latent_corr", f"WITH {TAU_SQL} SELECT i, j, round(tau_a, 6) AS tau FROM tau")
def latent_corr(spark, sf):
    """The tau-a that each fitted latent correlation implies must be the one observed."""
    return assoc.latent_corr(tables(spark, sf)).select("i", "j", r6("tau").alias("tau"))


@query("latent_rho")
def latent_rho(spark, sf):
    """The latent correlation of every pair."""
    return assoc.latent_corr(tables(spark, sf)).select("i", "j", "rho")


_cells = ", ".join(
    f"coalesce(max(printf('%.3f', round(v, 3) + 0.0)) FILTER (j = '{c}'), '') AS {c}" for c in ITEMS)


@query("assoc_wide", f"""
WITH {TAU_SQL}, m AS (SELECT i, j, phi AS v FROM tau UNION ALL SELECT j, i, phi FROM tau UNION ALL SELECT DISTINCT i, i, 1.0::DOUBLE FROM tau
  UNION ALL SELECT 'smoking', 'smoking', 1.0::DOUBLE)
SELECT i AS row_item, CASE i WHEN 'hx_returned' THEN 'returned' WHEN 'hx_deep_discount' THEN 'deep discount'
  WHEN 'hx_bulk' THEN 'bulk' WHEN 'hx_many' THEN 'many lines' END AS label, {_cells} FROM m GROUP BY i""")
def assoc_wide(spark, sf):
    labels = spark.createDataFrame(list(ITEM_NAMES.items()), "item string, label string")
    rounded = assoc.kendall_phi(tables(spark, sf)).withColumn("phi", F.round("phi", 3) + 0.0)
    return assoc.matrix_report(assoc.full_matrix(rounded, "phi"), ITEMS, labels)


MIXED = ["hx_high_tax", "smoking", "n_lines", "max_quantity", "age_calculated", "birth_day"]
MIXED_SQL = COHORT_SQL + """,
mixed AS (SELECT hx_high_tax::INT::DOUBLE AS hx_high_tax, CASE smoking_history_cigarette WHEN 'None' THEN 1 WHEN 'Passive Smoke as a Child' THEN 2
  WHEN 'Passive Smoke as am Adult' THEN 3 WHEN 'Past' THEN 4 WHEN 'Current' THEN 5 END::DOUBLE AS smoking, n_lines::DOUBLE AS n_lines,
  max_quantity::DOUBLE AS max_quantity, age_calculated::DOUBLE AS age_calculated, (date_of_birth - DATE '1970-01-01')::DOUBLE AS birth_day FROM cohort),
full_rows AS (SELECT * FROM mixed WHERE """ + " AND ".join(f"{c} IS NOT NULL" for c in MIXED) + """),
pairs AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS i, '{b}' AS j, {a} AS x, {b} AS y, count(*)::DOUBLE AS n FROM full_rows GROUP BY ALL"
    for k, a in enumerate(MIXED) for b in MIXED[k + 1:]) + """),
tot AS (SELECT i, j, sum(n) AS n, sum(n * x) / sum(n) AS mx, sum(n * y) / sum(n) AS my FROM pairs GROUP BY ALL),
moment AS (SELECT i, j, sum(p.n * (x - mx) * (y - my)) / sqrt(sum(p.n * (x - mx) ** 2) * sum(p.n * (y - my) ** 2)) AS phi FROM pairs p JOIN tot USING (i, j) GROUP BY ALL),
s AS (SELECT a.i, a.j, 2 * sum(CASE WHEN b.y < a.y THEN a.n * b.n WHEN b.y > a.y THEN -a.n * b.n ELSE 0 END) / 2 AS s
  FROM pairs a JOIN pairs b ON a.i = b.i AND a.j = b.j AND b.x < a.x GROUP BY ALL),
ti AS (SELECT i, j, sum(m * (m - 1) / 2) AS t FROM (SELECT i, j, x, sum(n) AS m FROM pairs GROUP BY ALL) GROUP BY ALL),
tj AS (SELECT i, j, sum(m * (m - 1) / 2) AS t FROM (SELECT i, j, y, sum(n) AS m FROM pairs GROUP BY ALL) GROUP BY ALL),
tau AS (SELECT i, j, n, s / (n * (n - 1) / 2) AS tau_a, s / sqrt((n * (n - 1) / 2 - ti.t) * (n * (n - 1) / 2 - tj.t)) AS tau_b, phi
  FROM tot JOIN s USING (i, j) JOIN ti USING (i, j) JOIN tj USING (i, j) JOIN moment USING (i, j))"""


def mixed(spark, sf):
    return cohort(spark, sf).select(
        F.col("hx_high_tax").cast("int").alias("hx_high_tax"), level_number(F.col("smoking_history_cigarette"), settings.SMOKING_LEVELS).alias("smoking"),
        "n_lines", "max_quantity", "age_calculated", F.unix_date("date_of_birth").alias("birth_day"))


@query("tau_continuous", f"""
WITH {MIXED_SQL} SELECT i, j, n::BIGINT AS n, round(tau_a, 6) + 0.0 AS tau_a, round(tau_b, 6) + 0.0 AS tau_b, round(phi, 6) + 0.0 AS phi FROM tau""")
def tau_continuous(spark, sf):
    """Rank correlation of flags, categories and numbers, all pairs."""
    found = rank_assoc.tau_pairs(mixed(spark, sf), MIXED)
    return found.select("i", "j", "n", *[r6(c).alias(c) for c in ("tau_a", "tau_b", "phi")])


@query("latent_mixed", f"WITH {MIXED_SQL} SELECT i, j, round(tau_a, 5) + 0.0 AS tau FROM tau")
def latent_mixed(spark, sf):
    """The tau-a that the latent correlation of each pair, numbers included, implies must be the one observed."""
    return rank_assoc.latent_mixed(mixed(spark, sf), MIXED).select("i", "j", (F.round("tau", 5) + 0.0).alias("tau"))


@query("latent_mixed_rho")
def latent_mixed_rho(spark, sf):
    """The latent correlation of each pair, numbers included."""
    return rank_assoc.latent_mixed(mixed(spark, sf), MIXED).select("i", "j", "rho")
