"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

1. A lexicon is learned from labelled texts: words, and word beginnings of 4 and 5 letters, that toxic texts hold far
   more often than others (a Spark count over terms). Obfuscated words are read through a table of look-alikes.
2. Each text becomes a few dense features: lexicon densities, nearness of lexicon hits to the second person, capitals,
   punctuation, obfuscation. Neither language nor source nor label nor id is a feature.
3. Boosted trees (Spark ML) are fitted on one part of the labelled texts and an isotonic map from their raw score to a
   probability on the other. Each half of the labelled texts is described with the lexicon of the other half, so that
   no text lends its own words to its features.

Learning uses a bounded sample of labelled rows: those with the lowest hash of their id, about `sample` of them. Scoring
covers every row, in bounded memory, with no shuffle of texts.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, staged

SAMPLE, THRESHOLD = 20_000, 0.7
#: Second-person forms of English, German, French and Spanish.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deiner euch euer ihr sie tu te toi ton ta tes vous votre vos usted ustedes ti tú tus vosotros".split())
#: Look-alikes in obfuscated words.
ALIKE = str.maketrans("013457@$!|", "oieastasil")
LETTERS = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
MIXED = re.compile(r"[^\W\d_][0-9@$!|*]+[^\W\d_]")
EDGES = ".,;:!?\"'()[]{}*#%&$|<>-_/"
NAMES = ("length", "hits", "density", "kinds", "strength", "strength_density", "best", "beginnings", "hidden", "second", "near_second", "capitals", "shouts", "marks", "exclaims", "obfuscated", "digits")


def plain(token: str) -> str:
    """A token as a word: edges stripped, lower-cased."""
    return token.strip(EDGES).lower()


def revealed(token: str) -> str:
    """A token with look-alikes read as letters and inner marks removed."""
    return re.sub(r"[^\w]|_", "", token.strip(".,;:?\"'()[]{}").lower().translate(ALIKE))


def terms(text: str) -> set[str]:
    """What the lexicon counts in a text: its words, and their beginnings (marked)."""
    words = {plain(t) for t in TOKEN.findall(text)}
    words |= {revealed(m) for m in TOKEN.findall(text) if MIXED.search(m)}
    words = {w for w in words if w and w.isalpha()}
    return words | {f"{w[:n]}~" for w in words for n in (4, 5) if len(w) >= n}


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """The dense features of a text, in the order of NAMES."""
    tokens = TOKEN.findall(text)
    n, get = max(1, len(tokens)), lexicon.get
    strength, best, at, second, kinds, begun, hidden, mixed, shouts = 0.0, 0.0, [], [], set(), 0, 0, 0, 0
    for i, t in enumerate(tokens):
        w = plain(t)
        value = get(w, 0.0)
        if not value and len(w) >= 4:
            value = max(get(w[:5] + "~", 0.0) if len(w) >= 5 else 0.0, get(w[:4] + "~", 0.0))
            begun += value > 0
        if not w.isalpha() and MIXED.search(t):
            mixed += 1
            if not value and (value := get(revealed(t), 0.0)):
                hidden += 1
        if value:
            strength += value
            best = max(best, value)
            at.append(i)
            kinds.add(w[:4])
        if w in SECOND:
            second.append(i)
        shouts += len(w) > 1 and t.isupper()
    near = sum(1 for i in at if (k := bisect.bisect_left(second, i - 5)) < len(second) and second[k] <= i + 5)
    size = max(1, len(text))
    capitals = sum(map(str.isupper, text)) / size
    marks = sum(map(text.count, ".,;:!?")) / size
    return [math.log1p(n), math.log1p(len(at)), len(at) / n, float(len(kinds)), math.log1p(strength), strength / n, best, begun / n, hidden / n, len(second) / n, near / max(1, len(at)), capitals, shouts / n, marks, text.count("!") / size, mixed / n, sum(map(str.isdigit, text)) / size if any(map(str.isdigit, text)) else 0.0]


def learn_lexicon(texts: DataFrame) -> dict[str, float]:
    """Terms of toxic texts with a lower confidence bound of their log odds; `texts`: text, toxic. What reaches the driver
    are terms in two or more toxic texts of the bounded sample whose bound passes 0.8, every one of them."""

    @F.pandas_udf("array<string>")
    def found(column: pd.Series) -> pd.Series:
        return column.map(lambda t: sorted(terms(t or "")))

    totals = texts.agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).first()
    bad, good = totals.bad or 0, (totals.n or 0) - (totals.bad or 0)
    if not bad or not good:
        return {}
    by_term = texts.select("toxic", F.explode(found("text")).alias("term")).groupBy("term").agg(F.sum("toxic").alias("t"), (F.count("*") - F.sum("toxic")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (bad + 1)) - F.log((F.col("c") + 0.5) / (good + 1))
    sure = odds - 1.64 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    strong = by_term.filter("t >= 2").select("term", sure.alias("sure")).filter("sure > 0.8")
    return {r.term: r.sure for r in strong.collect()}


class Model:
    """A learned lexicon, boosted trees and an isotonic map. `score` is a column of probabilities."""

    def __init__(self, lexicon: dict[str, float], trees=None, curve=None, prior: float = 0.0):
        self.lexicon, self.trees, self.curve, self.prior = lexicon, trees, curve, prior

    def described(self, docs: DataFrame, text: str, column: str) -> DataFrame:
        """`docs` with the feature array as one more column; only the text goes to Python."""
        return described(docs, text, column, self.lexicon)

    def scored(self, docs: DataFrame, text: str, column: str) -> DataFrame:
        """`docs` with the calibrated score as one more column."""
        if self.trees is None:
            return docs.withColumn(column, F.lit(float(self.prior)))
        names = [free_name(docs, f"_tox_{k}") for k in ("array", "vector", "raw", "probability", "prediction", "margin", "calibrated")]
        out = described(docs, text, names[0], self.lexicon).withColumn(names[1], array_to_vector(names[0]))
        model = self.trees.setFeaturesCol(names[1]).setRawPredictionCol(names[2]).setProbabilityCol(names[3]).setPredictionCol(names[4])
        out = model.transform(out).withColumn(names[5], vector_to_array(names[2])[1])
        curve = self.curve.setFeaturesCol(names[5]).setPredictionCol(names[6])  # linear between the fit's steps, all of them
        return curve.transform(out).withColumn(column, F.least(F.greatest(names[6], F.lit(0.0)), F.lit(1.0))).select(*docs.columns, column)


def described(docs: DataFrame, text: str, column: str, lexicon: dict[str, float]) -> DataFrame:
    send = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("array<double>")
    def dense(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = send.value
        for part in parts:
            yield part.map(lambda t: features(t or "", table))

    return docs.withColumn(column, dense(F.col(text)))


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, rounds: int = 20, depth: int = 4) -> Model:
    """A model from the labelled rows of `docs`. Rows without a label or an id are left out; an id labelled more than once
    counts once, and as toxic if any of its labels says so; rows of `docs` with the same id each count. Without both
    labels every score is the prior. Of the labelled ids about `sample` at most are used, those with the lowest hashes;
    only they are sent to all tasks, to pick out their texts."""
    given = labels.filter(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("_id")).agg(F.max((F.col(label) > 0).cast("long")).alias("toxic"))
    marks = staged(given.withColumn("h", F.xxhash64(F.col("_id").cast("string"))), "labels")
    total = marks.count()
    if total > sample:
        marks = marks.filter(F.pmod(F.col("h"), F.lit(1 << 20)) / float(1 << 20) < sample / total)
    rows = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(marks), "_id")
    half = F.pmod(F.shiftright("h", 20), F.lit(2)).alias("half")
    third = F.pmod(F.shiftright("h", 24), F.lit(3)).alias("third")
    rows = staged(rows.select("text", "toxic", half, third), "sample")
    lexicons = [learn_lexicon(rows.filter(f"half = {k}").select("text", "toxic")) for k in (0, 1)]
    both = learn_lexicon(rows.select("text", "toxic"))
    table = described(rows.filter("half = 0"), "text", "x", lexicons[1]).union(described(rows.filter("half = 1"), "text", "x", lexicons[0]))
    table = staged(table.select("toxic", "third", "x"), "features").select("third", F.col("toxic").cast("double").alias("toxic"), array_to_vector("x").alias("x"))
    counts = {(r.third == 0, r.toxic): r.n for r in table.groupBy("third", "toxic").agg(F.count("*").alias("n")).collect()}
    bad = sum(n for (_, t), n in counts.items() if t)
    prior = bad / max(1, sum(counts.values()))
    if not all(counts.get((k, t)) for k in (True, False) for t in (0.0, 1.0)):
        return Model(both, prior=prior)
    trees = GBTClassifier(featuresCol="x", labelCol="toxic", maxIter=rounds, maxDepth=depth, maxBins=32, stepSize=0.2, minInstancesPerNode=3, seed=7).fit(table.filter("third <> 0"))
    raw = trees.transform(table.filter("third = 0")).select("toxic", vector_to_array("rawPrediction")[1].alias("raw"))
    curve = IsotonicRegression(featuresCol="raw", labelCol="toxic").fit(raw)
    return Model(both, trees, curve, prior)


def not_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below `threshold`, columns as they are. A null text is scored as an empty one; repeated rows are
    judged alike; an empty table gives an empty result."""
    score = free_name(docs, "_score")
    return model.scored(docs, text, score).filter(F.col(score) < threshold).select(*docs.columns)
