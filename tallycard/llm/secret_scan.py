"""Secret scan: three patterns, and two character models whose likelihoods are compared. DataFrame expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycard.llm.common import docs_of, query

#: The kinds of the base rules, in their order. A failing match is one whose measured group is too short.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a run of 18 or more; a shorter run has no later start that is long enough
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12
KINDS = ["assign", "access", "hex", "markov"]
#: Characters of a token that the models know, and the tokens they judge: whole runs of 20 or more.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{3,}"
#: Texts that the models are trained on, at most about so many, chosen by a hash of the text; and generated strings.
TRAINING_TEXTS, GENERATED = 3000, 4000
#: A token is reported when the random-string model is e^15 times as likely as the identifier model, and at least
#: e^0.4 times per character, so that length alone does not decide.
LEAST_RATIO, LEAST_PER_CHAR = 15.0, 0.4


def _spans(text: Column, pattern: str, kind: int, group: int | None = None) -> Column:
    """Array of (start, kind, end, value) of the leftmost non-overlapping matches, in code points.

    What a regular expression splits off and what it finds alternate, so the places are running sums of their lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.arrays_zip(found.alias("found"), values.alias("value"), F.slice(between, 1, F.greatest(F.size(found), F.lit(1))).alias("gap"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def add(acc: Column, part: Column) -> Column:
        begin = acc["at"] + F.length(part["gap"])
        end = begin + F.length(part["found"])
        return F.struct(end.alias("at"), F.array_append(acc["spans"], F.struct(
            begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), part["value"].alias("value"))).cast(
                "array<struct<start:int,kind:int,end:int,value:string>>").alias("spans"))

    all_spans = F.aggregate(parts, start, add, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), all_spans).otherwise(empty)


def base_spans(text: Column) -> Column:
    """Spans of the three base rules, by start and kind."""
    assign = F.filter(_spans(text, ASSIGN, 0, group=1), lambda s: F.length(s["value"]) >= LEAST_VALUE)
    return F.array_sort(F.concat(assign, _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


def _bigrams(tokens: DataFrame, label: int) -> DataFrame:
    """label, bigram index and count of a column ``token``."""
    def at(i: Column) -> Column:
        return F.instr(F.lit(ALPHABET), F.substring(F.col("token"), i, F.lit(1))) - 1

    pairs = tokens.filter(F.length("token") >= 2).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: at(i) * len(ALPHABET) + at(i + 1))).alias("pair"))
    return pairs.groupBy("pair").agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "pair", "n")


def train_models(docs: DataFrame, text_col: str = "text", texts: int = TRAINING_TEXTS, generated: int = GENERATED) -> list[float]:
    """Log-likelihood ratio of each bigram, random strings against ordinary identifiers.

    Labelled samples: strings are what the base rules find and hash values written in several alphabets; identifiers are
    the words of a bounded sample of texts, alone and joined to names as programmers join them, and plain numbers. What
    reaches the driver is one count per bigram of the alphabet and label.
    """
    spark = docs.sparkSession
    total = max(docs.count(), 1)
    share = min(1.0, texts / total)
    sample = docs.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).filter(
        F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < math.ceil(share * 1_000_000))
    found = sample.select(F.explode(base_spans(F.col("text"))).alias("s")).select(F.regexp_replace("s.value", r"[^A-Za-z0-9+/_=-]", "").alias("token"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    raw = spark.range(generated).select(
        F.when(F.col("id") % 3 == 0, F.base64(F.unhex(digest))).when(F.col("id") % 3 == 1, digest)
        .otherwise(F.regexp_replace(F.upper(F.base64(F.unhex(digest))), "[^A-Z0-9]", "")).alias("token"))
    strings = found.unionByName(raw.select(F.regexp_replace("token", r"[^A-Za-z0-9+/_=-]", "").alias("token")))
    cleaned = F.regexp_replace("text", ASSIGN, " ")
    cleaned = F.regexp_replace(F.regexp_replace(cleaned, ACCESS, " "), HEX, " ")
    names = sample.select(F.regexp_extract_all(cleaned, F.lit(WORD), F.lit(0)).alias("w")).select(F.explode(F.transform(
        "w", lambda x, i: F.concat(x, F.element_at(F.array(*[F.lit(c) for c in ("", "_", "-", "/")]), (i % 4 + 1).cast("int")),
                                   F.coalesce(F.when(i % 4 > 0, F.get("w", i + 1)).otherwise(F.initcap(F.get("w", i + 1))), F.lit(""))))).alias("token"))
    # numbers, dates and counters are ordinary as well
    numbers = spark.range(generated).select(F.pmod(F.xxhash64("id"), F.lit(10 ** 12)).cast("string").alias("token"))
    counts = _bigrams(strings, 1).unionByName(_bigrams(names, 0)).unionByName(_bigrams(numbers, 0)).groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()
    size = len(ALPHABET)
    tables = [[1.0] * (size * size) for _ in range(2)]
    for row in counts:
        if row["pair"] is not None and 0 <= row["pair"] < size * size:
            tables[row["label"]][row["pair"]] += row["n"]
    ratio = []
    for a in range(size):
        sums = [sum(t[a * size:(a + 1) * size]) for t in tables]
        ratio += [math.log(tables[1][a * size + b] / sums[1]) - math.log(tables[0][a * size + b] / sums[0]) for b in range(size)]
    return ratio


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: list[float] | None = None) -> DataFrame:
    """id, ``base`` and ``extra``: arrays of (start, kind, end, value) of every row's whole text.

    ``base`` has what the patterns find, ``extra`` the tokens that the models call random and that no base span touches.
    A null or empty text has none. Repeated rows give equal results. An empty table trains on generated strings alone.
    """
    model = train_models(docs, text_col) if model is None else model
    # a literal list, folded once; its size is that of the alphabet squared
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in model)), ",").cast("array<double>")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", base_spans(F.col("text")).alias("base"), _spans(F.col("text"), TOKEN, 3).alias("tokens"))
    free = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
    size = len(ALPHABET)

    def ratio(t: Column) -> Column:
        def at(i: Column) -> Column:
            return F.instr(F.lit(ALPHABET), F.substring(t["value"], i, F.lit(1))) - 1

        return F.aggregate(F.sequence(F.lit(1), F.length(t["value"]) - 1), F.lit(0.0), lambda a, i: a + F.get(table, at(i) * size + at(i + 1)))

    def random(t: Column) -> Column:
        return (ratio(t) >= LEAST_RATIO) & (ratio(t) >= LEAST_PER_CHAR * F.length(t["value"]))

    return rows.select(F.col("id").alias(id_col), "base", F.filter(free, random).alias("extra"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(docs_of(spark, sf_dir))

    def of_kind(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    return found.select(
        "doc_id", of_kind(0).alias("n_assign"), of_kind(1).alias("n_access"), of_kind(2).alias("n_hex"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", "extra"))).alias("spans"), F.size("extra").cast("long").alias("n_markov"))
