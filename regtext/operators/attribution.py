"""Token attribution of linear count models as a table job.

The model is fitted on hashed counts, so what the driver holds has ``num_features`` numbers a label whatever the
vocabulary. Everything as long as the vocabulary stays a table: the token sums, the token dictionary with the feature
that every token falls on, and the attributions, of which a ranking window keeps ``k`` a label (its limit is applied
in every task before the shuffle).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .models import _fit_all


def totals(docs: DataFrame, labels: list[str]) -> dict[str, int]:
    """The number of rows, and of positive ones by label: one row reaches the driver."""
    row = docs.agg(F.count(F.lit(1)).alias("_n"), *[F.sum((F.col(l) == 1).cast("long")).alias(f"_n_{l}") for l in labels]).first()
    return {"": row["_n"], **{l: row[f"_n_{l}"] or 0 for l in labels}}


def token_sums(counts: DataFrame, token_col: str, labels: list[str], x: Column | None = None) -> DataFrame:
    """``(token, _s, _s_<label>..)``: the sum of ``x`` (1 a row by default) over all and over the positive rows; partial
    aggregates, so a frequent token costs one row a task."""
    x = F.lit(1) if x is None else x
    return counts.groupBy(F.col(token_col).alias("token")).agg(
        F.sum(x).alias("_s"), *[F.sum(F.when(F.col(l) == 1, x).otherwise(0)).alias(f"_s_{l}") for l in labels])


def attributed(sums: DataFrame, n: dict[str, int], labels: list[str], weight: Callable[[str], Column]) -> DataFrame:
    """``(token, label, attribution)`` with ``attribution = w * (sum over positives of x - n_pos * mean x)``; ``weight``
    gives the weight column of a label."""
    mean = F.col("_s") / F.lit(float(max(n[""], 1)))
    cells = [F.struct(F.lit(l).alias("label"), (weight(l) * (F.col(f"_s_{l}") - F.lit(float(n[l])) * mean)).alias("attribution")) for l in labels]
    return sums.select("token", F.inline(F.array(*cells)))


def linear_attribution(counts: DataFrame, docs: DataFrame, token_col: str, labels: list[str], weight: Column) -> DataFrame:
    """M14 arithmetic for token counts ``x`` per (document, token) and a weight that is an
    expression over the column ``token`` of the result."""
    sums = token_sums(counts, token_col, labels, F.col("x"))
    return attributed(sums, totals(docs, labels), labels, lambda l: weight)


def coefficient_table(spark: SparkSession, coefficients: dict[str, np.ndarray]) -> DataFrame:
    """``(feature, _w_<label>..)`` of the features that carry weight for some label: sparse rows of bounded arrays."""
    labels = list(coefficients)
    some = np.flatnonzero(np.any([coefficients[l] != 0 for l in labels], axis=0)) if labels else np.array([], dtype=int)
    rows = pd.DataFrame({"feature": some.astype("int32"), **{f"_w_{l}": coefficients[l][some].astype(float) for l in labels}})
    return spark.createDataFrame(rows, "feature int, " + ", ".join(f"`_w_{l}` double" for l in labels))


def token_features(tokens: DataFrame, num_features: int) -> DataFrame:
    """``tokens(token, ..)`` with ``feature``: the number that the hashing transformer gives the token."""
    hashed = HashingTF(inputCol="_one", outputCol="_v", numFeatures=num_features).transform(tokens.withColumn("_one", F.array("token")))
    return hashed.withColumn("feature", F.unwrap_udt("_v")["indices"][0]).drop("_one", "_v")


def weighted_attribution(sums: DataFrame, n: dict[str, int], coefficients: DataFrame, labels: list[str], num_features: int) -> DataFrame:
    """``(token, label, attribution)``: the token sums joined to the weights of their features (0 where there is none)."""
    both = token_features(sums, num_features).join(coefficients, "feature", "left")
    return attributed(both, n, labels, lambda l: F.coalesce(F.col(f"_w_{l}"), F.lit(0.0)))


def top_tokens(attributions: DataFrame, k: int) -> DataFrame:
    """The ``k`` tokens of highest attribution of every label (ties by token)."""
    order = Window.partitionBy("label").orderBy(F.col("attribution").desc(), "token")
    return attributions.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).drop("_rank")


def attribution(docs: DataFrame, key: str, text_col: str, label_df: DataFrame, labels: list[str], k: int = 20,
                reg: float = 0.01, num_features: int = 1 << 18, max_iter: int = 50) -> DataFrame:
    """Exact linear attribution of a logistic regression on hashed token counts, summed over the positive
    documents of each label -> the top ``k`` ``(label, token, attribution)``. Tokens on one feature share its weight;
    with ``num_features`` well above the vocabulary every token has its own."""
    tokens = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"[^\p{L}\p{N}]+", toLowercase=True) \
        .transform(docs.join(label_df, key)).select("_tok", *[F.col(l).cast("double").alias(l) for l in labels])
    rows = HashingTF(inputCol="_tok", outputCol="features", numFeatures=num_features).transform(tokens).select("features", *labels).persist()

    def fit(label):
        model = LogisticRegression(labelCol=label, featuresCol="features", regParam=reg, maxIter=max_iter)
        return model.fit(rows.filter(F.col(label).isNotNull())).coefficients.toArray()

    weights = coefficient_table(docs.sparkSession, dict(zip(labels, _fit_all(fit, labels))))
    rows.unpersist()
    sums = token_sums(tokens.select(F.explode("_tok").alias("token"), *labels), "token", labels)
    best = top_tokens(weighted_attribution(sums, totals(tokens, labels), weights, labels, num_features), k)
    return best.select("label", "token", "attribution")
