"""Queries for the machine-learning operators.

Model fits are not expressible in SQL; their queries are checked by rows here
and by value in the tests.  All fit the operators' default rounds and depth.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from plumbline.operators import learning
from plumbline.plans.tables import table


def _prices(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus", "l_extendedprice"
    )


def _quality(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    documents = table(spark, sf_dir, "documents")
    text = F.col("text")
    return labels.join(documents, "doc_id").select(
        "n_chars",
        "lang",
        "source",
        F.size(F.split(text, r"\s+")).alias("words"),
        F.size(F.split(text, "\n")).alias("lines"),
        F.length(F.regexp_replace(text, r"[^0-9]", "")).alias("digits"),
        "toxic",
        "quality",
    )


def _trained(data, spark, sf_dir, target, task):
    prepared = learning.prepare(data(spark, sf_dir), target, task)
    return prepared, learning.fit(prepared)


def _fit_query(data, target, task, spark, sf_dir):
    prepared, model = _trained(data, spark, sf_dir, target, task)
    score = learning.train_score(prepared, model)
    return learning.tree_importance(prepared, model).select(
        "feature",
        F.round("importance", 6).alias("importance"),
        F.lit(prepared.count).alias("n_samples"),
        F.lit(round(score, 6)).alias("train_score"),
    )


gbt_regression = partial(_fit_query, _prices, "l_extendedprice", "regression")
gbt_classification = partial(_fit_query, _quality, "quality", "classification")


def cv_score(spark, sf_dir):
    return learning.cv_score(learning.prepare(_prices(spark, sf_dir), "l_extendedprice"))


def permutation_importance(spark, sf_dir):
    prepared, model = _trained(_prices, spark, sf_dir, "l_extendedprice", "regression")
    return learning.permutation_importance(prepared, model)


def tree_importance(spark, sf_dir):
    return learning.tree_importance(*_trained(_prices, spark, sf_dir, "l_extendedprice", "regression"))


def leakage_screen(spark, sf_dir):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = _prices(spark, sf_dir).withColumn("net_price", net)
    result = learning.leakage_screen(rows, "l_extendedprice")
    return result.select("feature", F.round("r", 6).alias("r"), "leaks")


QUERIES = {
    "gbt_regression": gbt_regression,
    "gbt_classification": gbt_classification,
    "cv_score": cv_score,
    "permutation_importance": permutation_importance,
    "tree_importance": tree_importance,
    "leakage_screen": leakage_screen,
}

_FEATURES = {
    "l_quantity": "l_quantity", "l_discount": "l_discount", "l_tax": "l_tax", "l_linenumber": "l_linenumber",
    "net_price": "l_extendedprice * (1 - l_discount)",
}

ORACLE = {
    "leakage_screen": " UNION ALL ".join(
        f"""SELECT '{name}' AS feature, ROUND(corr({e}, l_extendedprice), 6) AS r, abs(corr({e}, l_extendedprice)) >= 0.95 AS leaks
        FROM lineitem"""
        for name, e in _FEATURES.items()
    )
}
