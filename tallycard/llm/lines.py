"""Line deduplication by site spread: lines that many sites share are boilerplate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycard.llm.common import docs_of, query, row_key, settled

#: A line on so many distinct sites is boilerplate.
LEAST_SITES = 8
LG_K = 12


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """One row per line with a word: id, content key, place, 128-bit hash, site."""
    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col, site_col).alias("key"), F.col(site_col).cast("string").alias("site"),
                       F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("place", "line"))
    rows = rows.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select("id", "key", "site", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.length("line").alias("chars"))


def spread_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", least_sites: int = LEAST_SITES) -> DataFrame:
    """Hashes (h1, h2) of the lines that are on ``least_sites`` distinct sites or more.

    A sketch per line merges over the tasks before and after the shuffle, so a line that every text has is a few rows.
    An estimate that could lie on either side of the threshold is settled by an exact distinct count. Null sites do not count.
    """
    lines = _lines(docs, id_col, text_col, site_col)
    sketched = settled(
        lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.count("*").alias("n")).filter(F.col("n") >= least_sites)
        .select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")))
    band = max(2, int(least_sites * 4 * 1.04 / 2 ** (LG_K / 2)) + 1)
    near = sketched.filter((F.col("sites") >= least_sites - band) & (F.col("sites") <= least_sites + band)).select("h1", "h2")
    pairs = lines.select("h1", "h2", "site").join(near, ["h1", "h2"], "left_semi").distinct()
    exact = pairs.groupBy("h1", "h2").agg(F.count("site").alias("sites")).filter(F.col("sites") >= least_sites).select("h1", "h2")
    return settled(sketched.filter(F.col("sites") > least_sites + band).select("h1", "h2").unionByName(exact))


def without_spread_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                         least_sites: int = LEAST_SITES, most_share: float | None = None) -> DataFrame:
    """``row`` (the whole row as a struct), ``n_lines``, ``n_flagged``, ``n_removed`` and ``kept_text`` of every row of ``docs``.

    Flagged lines go. With a ``most_share``, a text in which they have more of the characters of its lines is left whole.
    Other lines, lines without a word included, stay in order. A null text stays null. Repeated rows are
    treated alike.
    """
    flagged = spread_lines(docs, id_col, text_col, site_col, least_sites)
    hits = _lines(docs, id_col, text_col, site_col).join(flagged, ["h1", "h2"], "left_semi")
    places = hits.groupBy("id", "key").agg(F.array_sort(F.collect_set(F.struct("place", "chars"))).alias("hits"))  # at most the lines of one text
    places = places.select(F.col("id").alias("hit_id"), F.col("key").alias("hit_key"), "hits")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), row_key(id_col, text_col, site_col).alias("key"), F.col(text_col).alias("text"))
    joined = rows.join(places, rows["id"].eqNullSafe(places["hit_id"]) & (rows["key"] == places["hit_key"]), "left")
    lines = F.split("text", "\n")
    within = F.lit(True)
    if most_share is not None:
        flagged_chars = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["chars"])
        # line breaks and lines without a word do not count
        worded = F.aggregate(F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]")), F.lit(0).cast("long"), lambda a, x: a + F.length(x))
        within = flagged_chars <= most_share * worded
    out = joined.select(
        "row", "text", "hits",
        F.coalesce(F.size(F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("hits").isNull(), 0).otherwise(F.size("hits")).cast("long").alias("n_flagged"),
        F.coalesce(F.when(F.col("hits").isNotNull(), within), F.lit(False)).alias("clean"),
    )
    places_left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.transform("hits", lambda x: x["place"]))
    out = out.withColumn("lines", F.when(F.col("clean"), F.split("text", "\n")))
    # "lines" is used twice, so it stays a column that is made once per row
    kept = F.array_join(F.transform(places_left, lambda i: F.get("lines", i)), "\n")
    return out.select("row", "n_lines", "n_flagged", F.when(F.col("clean"), F.col("n_flagged")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
                      F.when(F.col("clean"), kept).otherwise(F.col("text")).alias("kept_text"))


def drop_spread_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", size_col: str = "n_chars") -> DataFrame:
    """``docs`` without the flagged lines, whatever their share, and, where the column is there, with the new lengths; no row goes."""
    out = without_spread_lines(docs, id_col, text_col, site_col)
    types = {f.name: f.dataType for f in docs.schema.fields}

    def column(c: str):
        if c == text_col:
            return F.col("kept_text").alias(c)
        old = F.col("row").getField(c)
        return (F.when(F.col("n_removed") > 0, F.length("kept_text").cast(types[c])).otherwise(old) if c == size_col else old).alias(c)

    return out.select(*[column(c) for c in docs.columns])


OP3_SQL = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
w AS (SELECT * FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
s AS (SELECT line FROM w GROUP BY line HAVING count(DISTINCT source) >= {LEAST_SITES}),
d AS (SELECT doc_id, count(*) AS n_lines, count(s.line) AS n_flagged FROM w LEFT JOIN s USING (line) GROUP BY doc_id),
k AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.place) AS kept
  FROM l LEFT JOIN s USING (line) WHERE s.line IS NULL GROUP BY l.doc_id)
SELECT x.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_flagged, 0) AS n_flagged, coalesce(n_flagged, 0) AS n_removed, md5(coalesce(kept, '')) AS kept_md5
FROM documents x LEFT JOIN d USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@query("op3_line_spread", OP3_SQL)
def op3_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_spread_lines(docs_of(spark, sf_dir))
    return out.select("row.doc_id", "n_lines", "n_flagged", "n_removed", F.md5(F.coalesce("kept_text", F.lit(""))).alias("kept_md5"))


@query("op3_line_spread_all", OP3_SQL)
def op3_line_spread_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier name of the same query."""
    return op3_line_spread(spark, sf_dir)
