"""Language identification from words, characters and probabilities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, IDFModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

EPSILON = 1e-9

# Function words and spellings that mark a language.
MARKERS = {
    "ach": [
        "tye", "atye", "gitye", "kun", "dok", "woko", "dano", "latin", "obedo", "aneno", "adada", "madit", "matidi",
        "acel", "aryo", "ngat", "ento", "piny", "gin", "kome", "komgi", "kacel", "kiketo", "apura", "gang", "myel",
        "lum", "wiye", "cinge", "bongo", "kingi", "malac", "maleng", "pii",
    ],
    "nyn": [
        "aha", "kandi", "hariho", "harimu", "ariyo", "kwonka", "nari", "omushaija", "abashaija", "omukazi", "abakazi",
        "amaizi", "rubaju", "enyuma", "nindeeba", "omuri", "eine", "erikwera", "ndikubona", "obwato", "ekishushani",
        "aineho", "arimu", "bariyo", "nibakoresa", "ahandikireho",
    ],
    "xog": [
        "nenga", "gundi", "umulala", "ndala", "zene", "kwene", "budambi", "mwene", "zinzu", "zingubo", "zisuubo",
        "ngaji", "idani", "baseza", "matafali", "masanyalaze", "kisaala", "bisaala", "mukana", "liguje",
    ],
    "myx": [
        "bakhasi", "abandu", "umundu", "kameetsi", "kametsi", "umusaani", "tsingubo", "tsikhu", "lugudo", "khundulo",
        "bibyambako", "likholelo", "angolobe", "khayuni", "imbata", "kamatoore", "ikofiira",
    ],
}
#: Fixed values: (language, weight, what) of spellings that count wherever they occur, and of a prefix of long words.
SPELLINGS = [("myx", 0.6, "kh"), ("myx", 0.4, "tsi")]
PREFIXES = [("xog", 0.5, "zi", 3)]


def marker_scores(text: Column, markers: dict[str, list[str]] = MARKERS) -> dict[str, Column]:
    """A score for every language: its marker words, spellings and prefixes."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.filter(F.split(low, "[^a-z']+"), lambda w: w != "")
    among = lambda listed: F.size(F.filter(words, lambda w: w.isin(listed)))
    begun = lambda what, longer: F.size(F.filter(words, lambda w: w.startswith(what) & (F.length(w) > longer)))
    out = {}
    for lang, listed in markers.items():
        score = among(listed).cast("double")
        for where, weight, what in SPELLINGS:
            if where == lang:
                score = score + weight * ((F.length(low) - F.length(F.regexp_replace(low, what, ""))) / len(what))
        for where, weight, what, longer in PREFIXES:
            if where == lang:
                score = score + weight * begun(what, longer)
        out[lang] = score
    return out


def by_markers(df: DataFrame, text: str, markers: dict[str, list[str]] = MARKERS) -> DataFrame:
    """``language`` and ``confidence``; ``unk`` where the markers are too few."""
    scored = df.withColumns({f"__{k}": v for k, v in marker_scores(F.col(text), markers).items()})
    listed = F.array(*[F.struct(F.round(F.col(f"__{k}"), 9).alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(markers)])
    best, total = F.array_max(listed), sum((F.col(f"__{k}") for k in markers), F.lit(0.0))
    words = F.size(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z']+"), lambda w: w != ""))
    confidence = F.when(total > 0, best["s"] / total).otherwise(0.0)
    # fixed values: the least score, and the least confidence and density of markers of which one has to be reached
    unknown = (total == 0) | (best["s"] < 2) | ((confidence < 0.45) & (best["s"] / F.greatest(words, F.lit(1)) < 0.08))
    return scored.withColumns({"language": F.when(unknown, "unk").otherwise(best["k"]), "confidence": F.round(confidence, 9)}).drop(*[f"__{k}" for k in markers])


def top_two(probabilities: dict[str, Column], gate: float | None = None) -> dict[str, Column]:
    """The likeliest language, its probability and its lead; ``unk`` below the gate. Ties go to the first name."""
    ranked = F.array_sort(F.array(*[F.struct((-p).alias("p"), F.lit(k).alias("k")) for k, p in probabilities.items()]))
    first, second = F.element_at(ranked, 1), F.try_element_at(ranked, F.lit(2))
    confidence = -first["p"]
    language = first["k"] if gate is None else F.when(confidence < gate, "unk").otherwise(first["k"])
    return {"language": language, "confidence": confidence, "margin": confidence + F.coalesce(second["p"], F.lit(0.0))}


def fuse(a: dict[str, Column], b: dict[str, Column], weight: Column | float) -> dict[str, Column]:
    """Two views' probabilities, their logarithms mixed and made to add up to 1 again."""
    w = F.lit(weight) if isinstance(weight, float) else weight
    clip = lambda p: F.greatest(p, F.lit(EPSILON))
    raw = {k: F.exp(w * F.ln(clip(a[k])) + (1 - w) * F.ln(clip(b[k]))) for k in a}
    total = sum(raw.values(), F.lit(0.0))
    return {k: v / total for k, v in raw.items()}


def fusion_grid(df: DataFrame, a: dict[str, str], b: dict[str, str], truth: str, steps: int = 100) -> DataFrame:
    """(weight, macro_accuracy) for every weight of a grid.

    Each row is judged under all weights where it is; what is shuffled are counts by weight and language.
    """
    grid = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / float(steps))
    each = df.withColumn("weight", F.explode(grid))
    guess = top_two(fuse({k: F.col(v) for k, v in a.items()}, {k: F.col(v) for k, v in b.items()}, F.col("weight")))["language"]
    right = each.select("weight", F.col(truth).alias("t"), (guess == F.col(truth)).alias("r")).groupBy("weight", "t").agg((F.count_if("r") / F.count(F.lit(1))).alias("acc"))
    return right.groupBy("weight").agg(F.round(F.avg("acc"), 9).alias("macro_accuracy"))


def best_weight(grid: DataFrame) -> DataFrame:
    """The weight with the best accuracy, the one closest to one half on a tie."""
    return grid.agg(F.max_by(F.struct("weight", "macro_accuracy"), F.struct("macro_accuracy", (-F.round(F.abs(F.col("weight") - 0.5), 9)).alias("d"), (-F.col("weight")).alias("w"))).alias("r")).select("r.*")


def by_likelihood(scores: DataFrame, key: str = "id", language: str = "language", score: str = "lm_score") -> DataFrame:
    """(key, language, margin): the language whose model likes a text best, and by how much."""
    ranked = scores.groupBy(key).agg(F.max_by(language, F.struct(score, language)).alias("language"), F.max(score).alias("top"), F.max_by(score, F.struct(score, language)).alias("s"), F.sort_array(F.collect_list(score), asc=False).alias("all"))
    return ranked.select(key, "language", F.round(F.col("top") - F.coalesce(F.try_element_at("all", F.lit(2)), F.col("top")), 9).alias("margin"))


def char_ngrams(text: Column, low: int = 2, high: int = 6) -> Column:
    """Character n-grams inside the words of a text, words padded by blanks."""
    words = F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Z}]+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    cut = lambda n: F.flatten(F.transform(words, lambda w: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))))
    return F.concat(*[cut(n) for n in range(low, high + 1)])


def _damped(v: SparseVector) -> SparseVector:
    """1 + ln of every count; vectors have no expression for it."""
    return SparseVector(v.size, v.indices, 1.0 + np.log(v.values))


@dataclass(frozen=True)
class TextLid:
    """A fitted identifier: its labels in order, the weights of n-grams and the logistic model."""

    labels: tuple[str, ...]
    features: int
    weights: IDFModel
    model: LogisticRegressionModel

    def vectors(self, df: DataFrame, text: str) -> DataFrame:
        return self.weights.transform(_counts(df, text, self.features))


def _counts(df: DataFrame, text: str, features: int) -> DataFrame:
    hashed = HashingTF(inputCol="__grams", outputCol="__counts", numFeatures=features).transform(df.withColumn("__grams", char_ngrams(F.col(text))))
    # written first: a Python function of a column made by lambdas is not always taken out of the plan
    return cut(hashed.drop("__grams")).withColumn("__tf", F.udf(_damped, VectorUDT())("__counts")).drop("__counts")


def train_text_lid(df: DataFrame, text: str, label: str, features: int = 1 << 18, max_iter: int = 30) -> TextLid:
    """Damped, weighted character n-grams inside words and a logistic model with balanced classes and C = 4."""
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect() if r[label] is not None}
    labels, total = tuple(sorted(sizes)), sum(sizes.values())
    known = df.filter(F.col(label).isNotNull())
    counted = cut(_counts(known, text, features).select("__tf", (F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)) - 1).cast("double").alias("__target")))
    weights = IDF(inputCol="__tf", outputCol="__x", minDocFreq=2).fit(counted)
    balance = F.create_map(*[F.lit(v) for i, x in enumerate(labels) for v in (float(i), total / (len(labels) * sizes[x]))])[F.col("__target")]
    ready = weights.transform(counted).withColumn("__weight", balance)
    logistic = LogisticRegression(featuresCol="__x", labelCol="__target", weightCol="__weight", predictionCol="__k", probabilityCol="__p", rawPredictionCol="__raw", maxIter=max_iter, regParam=0.25 / max(total, 1))
    return TextLid(labels, features, weights, logistic.fit(ready))


def apply_text_lid(model: TextLid, df: DataFrame, text: str) -> DataFrame:
    """``predicted``, ``confidence``: the likeliest label of the fitted model."""
    scored = model.model.transform(model.vectors(df, text))
    labels = F.array(*[F.lit(x) for x in model.labels])
    return scored.withColumns({"predicted": F.element_at(labels, F.col("__k").cast("int") + 1), "confidence": F.array_max(vector_to_array("__p"))}).drop("__tf", "__x", "__k", "__p", "__raw")


def train_vector_lid(df: DataFrame, vector: str, label: str, max_iter: int = 50):
    """A fitted pipeline on pooled feature arrays: standardized, then a logistic model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    prepared = df.withColumns({"features": array_to_vector(F.col(vector).cast("array<double>")), "target": F.col(label).cast("double")})
    stages = [StandardScaler(inputCol="features", outputCol="scaled", withMean=True), LogisticRegression(featuresCol="scaled", labelCol="target", maxIter=max_iter, regParam=0.01)]
    return Pipeline(stages=stages).fit(prepared)


def apply_vector_lid(model, df: DataFrame, vector: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    scored = model.transform(df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))))
    return scored.withColumns({"predicted": F.col("prediction").cast("int"), "confidence": F.array_max(vector_to_array("probability"))}).drop("features", "scaled", "rawPrediction", "probability", "prediction")


