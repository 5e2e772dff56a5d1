"""Toxicity: boosted trees over dense text features, with calibrated scores."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycard.llm.common import docs_of, query, settled

#: Labelled rows that the models are fitted on, at most about so many, chosen by a hash of the id.
MAX_TRAINING = 20_000
#: Words of the learned lexicon, at most; each is in this share of the toxic training texts at least, and its share
#: there is so many times that in the others.
MAX_LEXICON, LEAST_SHARE, LEAST_LIFT = 300, 0.02, 8.0
#: Insults that count whatever the training rows say, and words of the second person.
INSULTS = "idiot moron stupid scum trash loser pathetic worthless disgusting clown imbecile dumb".split()
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes ti tus vosotros".split())
NEAR = 5
#: Characters that stand for letters in disguised words.
DISGUISE = str.maketrans({"0": "o", "1": "i", "!": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "*": "", "_": "", ".": "", "-": ""})
TOKEN = re.compile(r"[^\W_](?:[^\s]*[^\W_])?")
FEATURES = ["lexicon", "lexicon_any", "lexicon_seen", "insult", "near_person", "person", "capitals", "shouted", "exclaim", "punctuation",
            "masked", "disguised", "stretched", "spaced", "length", "stems", "stem_rate"]
#: The learned lexicon also has beginnings of words, written with a star.
STEMS = (5, 6, 7)


def text_features(text: str, lexicon: frozenset[str]) -> tuple[float, ...]:
    """Rates of one whole text; all are zero for an empty one. A helper that looks at nothing but the text."""
    raw = text.split()
    n = len(raw)
    if not n:
        return (0.0,) * len(FEATURES)
    lower = text.lower()
    tokens = TOKEN.findall(lower)
    hits = [i for i, t in enumerate(tokens) if t in lexicon]
    stems = sum(1 for t in tokens if len(t) > STEMS[0] and any(t[:k] + "*" in lexicon for k in STEMS if len(t) > k))
    insults = sum(1 for i in hits if tokens[i] in INSULT_SET)
    persons = [i for i, t in enumerate(tokens) if t in SECOND_PERSON]
    near, p = 0, 0
    for i in hits:
        while p < len(persons) and persons[p] < i - NEAR:
            p += 1
        near += p < len(persons) and persons[p] <= i + NEAR
    masked = disguised = 0
    for t in MASKED.findall(lower):
        plain = t.translate(DISGUISE)
        if plain != t and plain.isalpha():
            masked += 1
            disguised += plain in lexicon
    letters = sum(map(str.isalpha, text)) or 1
    upper = sum(map(str.isupper, text))
    shouted = sum(1 for w in raw if len(w) > 2 and w.isupper())
    stretched = len(STRETCHED.findall(lower))
    spaced = len(SPACED.findall(lower))
    marks = lower.count("!") + lower.count("?")
    return (
        100 * len(hits) / n, float(bool(hits)), math.log1p(len(hits)), math.log1p(insults), math.log1p(near), 100 * len(persons) / n,
        upper / letters, shouted / n, marks / n, sum(map(lower.count, ".,;:")) / n, masked / n, math.log1p(disguised), stretched / n, spaced / n, math.log1p(n),
        math.log1p(stems), 100 * stems / n,
    )


INSULT_SET = frozenset(INSULTS)
MASKED = re.compile(r"[^\W\d_]+[0134578@$!*]+[^\W\d_]+[^\s]*")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
SPACED = re.compile(r"\b(?:[^\W\d_] ){3,}[^\W\d_]\b")


def _remainder(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """id, text, label of a bounded sample of the labelled rows outside the held-out fifth."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).filter("id is not null and label in (0, 1)")
    known = known.filter(_remainder("id") != 0).dropDuplicates(["id"])
    share = min(1.0, most / max(known.count(), 1))
    known = settled(known.filter(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1_000_000)) < math.ceil(share * 1_000_000)))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(known, "id")


def learned_lexicon(rows: DataFrame) -> frozenset[str]:
    """Words that are far more frequent among the toxic training texts, with the fixed insults."""
    def distinct_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[float, Counter] = {0.0: Counter(), 1.0: Counter()}
            for text, label in zip(batch["text"], batch["label"]):
                own = set(TOKEN.findall(text.lower()))
                seen[label].update(own | {w[:k] + "*" for w in own for k in STEMS if len(w) > k})
            words = sorted(seen[0.0].keys() | seen[1.0].keys())
            yield pd.DataFrame({"word": words, "clean": [seen[0.0][w] for w in words], "toxic": [seen[1.0][w] for w in words]})

    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1.0, 0), sizes.get(0.0, 0)
    if not toxic or not clean:
        return INSULT_SET
    counts = rows.select("text", "label").mapInPandas(distinct_words, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lift = (F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("clean") + 0.5) / (clean + 1))
    best = counts.filter((F.col("toxic") >= max(3, LEAST_SHARE * toxic)) & (F.length("word") >= 3)).withColumn("lift", lift).filter(F.col("lift") >= LEAST_LIFT)
    # its size is a parameter: what reaches the driver does not grow with the input
    return INSULT_SET | {r["word"] for r in best.orderBy(F.desc("toxic"), "word").limit(MAX_LEXICON).collect()}


def with_features(rows: DataFrame, lexicon: frozenset[str], keep: list[str]) -> DataFrame:
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [text_features(t, lexicon) for t in batch["text"]]
            yield pd.concat([batch[keep].reset_index(drop=True), pd.DataFrame(found, columns=FEATURES, dtype="float64")], axis=1)

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"{c} {types[c]}" for c in keep] + [f"{c} double" for c in FEATURES])
    return rows.select(*keep, "text").mapInPandas(measure, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                   most: int = MAX_TRAINING, trees: int = 20, depth: int = 3) -> DataFrame:
    """id, ``held_out``, ``score`` and ``predicted`` of every row of ``docs``.

    The score depends on the text alone. The lexicon and the trees are fitted on four fifths of the training rows, the
    isotonic curve from tree margin to probability on the rest. A small share of the margin is kept in the score, so
    that rows on one step of the curve are still ordered. Without labels of both kinds every score is the share of
    positive labels, 0 without any. A null text counts as empty; a null id is not held out; repeated rows score alike.
    """
    # ids travel as text through Python, as null numbers would lose digits on the way
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = [F.col("id").cast(id_type).alias(id_col), F.coalesce(_remainder("id") == 0, F.lit(False)).alias("held_out")]
    sample = settled(training_rows(docs, labels, id_col, text_col, label_col, most))
    fold = F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(5)) == 0
    sizes = {(r["fold"], r["label"]): r["n"] for r in sample.groupBy(fold.alias("fold"), "label").agg(F.count("*").alias("n")).collect()}
    if not all(sizes.get((f, y)) for f in (True, False) for y in (0.0, 1.0)):
        share = sum(n for (_, y), n in sizes.items() if y) / max(sum(sizes.values()), 1)
        return rows.select(*out, F.lit(float(share)).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    lexicon = learned_lexicon(sample.filter(~fold))
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    measured = settled(with_features(sample, lexicon, ["id", "label"]))
    fit = assemble.transform(measured.filter(~fold)).select("features", "label").coalesce(4)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, maxBins=64).fit(fit)
    margin = vector_to_array("rawPrediction")[1]
    seen = model.transform(assemble.transform(measured.filter(fold))).select(margin.alias("margin"), "label")
    curve = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="calibrated").fit(seen)
    scored = model.transform(assemble.transform(with_features(rows, lexicon, ["id"]))).withColumn("margin", margin)
    # one row in a thousand of a step's width goes to the order of margins
    score = 0.998 * F.col("calibrated") + 0.002 / (1 + F.exp(-2 * F.col("margin")))
    scored = curve.transform(scored.select("id", "margin")).withColumn("score", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))
    return scored.select(*out, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(docs_of(spark, sf_dir), docs_of(spark, sf_dir, "labels"))
