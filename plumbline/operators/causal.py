"""Treatment effects: naive, noise scan, stratified, scoreboard."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from plumbline.config import DEFAULTS
from plumbline.functions.numeric import ratio
from plumbline.operators.associate import association
from plumbline.operators.audit import violations
from plumbline.operators.compare import t_test, two_sample_moments
from plumbline.operators.discovery import bh_fdr


def naive_ate(df: DataFrame, outcome: str, treated: Column, groups: list[str], alpha: float = DEFAULTS.alpha) -> DataFrame:
    """Unadjusted mean difference treated - control with a pooled t test."""
    moments = two_sample_moments(df, outcome, treated, groups).withColumn("equal_var", F.lit(True))
    return t_test(moments, alpha).select(
        *groups,
        F.col("n_b").alias("n_treated"),
        F.col("n_a").alias("n_control"),
        F.col("diff").alias("estimate"),
        "statistic",
        F.col("p").alias("p_value"),
    )


def noise_scan(df: DataFrame, candidates: list[str], outcome: str, alpha: float = DEFAULTS.alpha) -> DataFrame:
    """Correlation of every candidate with the outcome, before and after FDR control."""
    long = df.select(
        F.col(outcome).cast("double").alias("_y"),
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("candidate"), F.col(c).cast("double").alias("_x")) for c in candidates])
        ),
    )
    tested = association(long, "_x", "_y", ["candidate"]).select(
        "candidate", "n", F.col("pearson_r").alias("r"), F.coalesce("pearson_p", F.lit(1.0)).alias("p"), F.lit(0).alias("family")
    )
    corrected = bh_fdr(tested, ["family"])
    return corrected.select(
        "candidate", "n", "r", "p", "q", (F.col("p") < alpha).alias("naive_discovery"), (F.col("q") < alpha).alias("fdr_discovery")
    )


def stratified_ate(df: DataFrame, outcome: str, treated: Column, stratum: list[str]) -> DataFrame:
    """Effect on the treated (and on all units) from per-stratum differences.

    Strata without both arms are left out.  Standard errors come from the
    within-stratum variances; an arm of one unit has none, so its stratum makes
    the error unknown (null).
    """
    strata = two_sample_moments(df, outcome, treated, stratum).where("n_a > 0 and n_b > 0")
    diff = F.col("mean_b") - F.col("mean_a")
    variance = ratio(F.col("var_b"), F.col("n_b")) + ratio(F.col("var_a"), F.col("n_a"))
    w_att, w_ate = F.col("n_b").cast("double"), (F.col("n_a") + F.col("n_b")).cast("double")

    def weighted(weight):
        return ratio(F.sum(weight * diff), F.sum(weight))

    def error(weight):
        known = F.count(variance) == F.count(F.lit(1))
        return F.when(known, F.sqrt(ratio(F.sum(weight * weight * variance), F.sum(weight) ** 2)))

    return strata.agg(
        F.count(F.lit(1)).alias("strata"),
        F.sum("n_b").alias("n_treated"),
        F.sum("n_a").alias("n_control"),
        weighted(w_att).alias("att"),
        error(w_att).alias("att_se"),
        weighted(w_ate).alias("ate"),
        error(w_ate).alias("ate_se"),
    )


def estimator_scoreboard(methods: list[DataFrame], truth: float) -> DataFrame:
    """Estimates beside the known truth.

    Each method frame has ``method, estimate, violations, false_discoveries``.
    """
    rows = reduce(DataFrame.unionByName, methods)
    return rows.select(
        "method",
        F.lit(float(truth)).alias("truth"),
        "estimate",
        F.abs(F.col("estimate") - F.lit(float(truth))).alias("absolute_error"),
        "violations",
        F.when(F.col("violations") > 0, 1.0).otherwise(0.0).alias("hallucination_rate"),
        "false_discoveries",
    )


_CLAIMS = "run_id string, claim_id string, summary string, verdict string, evidence_ids array<string>, columns array<string>"
_EVIDENCE = (
    "run_id string, id string, kind string, test_name string, code string, params map<string,string>, "
    "result map<string,double>"
)


def naive_claims(estimate: float, noise_columns: list[str]) -> list[tuple]:
    """What an unguarded analysis would write: causal wording, no evidence."""
    effect = f"Being treated caused {estimate:.2f} more spend."
    claims = [("naive", "claim_1", effect, "", [], [])]
    for column in noise_columns:
        text = f"{column} has a significant influence."
        claims.append(("naive", f"claim_{column}", text, "", [], []))
    return claims


def controlled_claim(estimate: float, outcome: str) -> tuple:
    text = f"Within strata, treated units differ by {estimate:.2f} on average."
    return ("stratified", "H1", text, "supported", ["ev_0001"], [outcome])


def controlled_evidence(stratified: Row, naive: float) -> tuple:
    """The stratified estimate as evidence, with computed p and attenuation."""
    result = {
        "controlled_effect": stratified.att,
        "n": float(stratified.n_treated + stratified.n_control),
        "attenuation_ratio": abs(stratified.att) / abs(naive) if abs(naive) > 1e-9 else 1.0,
    }
    if stratified.att_se:
        result["p_value"] = math.erfc(abs(stratified.att / stratified.att_se) / math.sqrt(2.0))
    params = {"controls": "stratum"}
    return ("stratified", "ev_0001", "stat_test", "controlled_association", "stratified_ate", params, result)


def scoreboard(
    df: DataFrame, outcome: str, treated: Column, stratum: list[str], noise_columns: list[str], truth: float
) -> DataFrame:
    """Naive and stratified estimate against a known effect, each with its audited claims.

    The estimates are single rows, and the noise scan has one row per candidate
    column: they come to the driver, where the claims about them are written.
    """
    spark = df.sparkSession
    naive = naive_ate(df, outcome, treated, []).first()
    stratified = stratified_ate(df, outcome, treated, stratum).first()
    if naive.estimate is None or stratified.att is None:
        raise ValueError("no stratum holds treated and untreated units")
    false = [r.candidate for r in noise_scan(df, noise_columns, outcome).where("naive_discovery").collect()]
    claims = [*naive_claims(naive.estimate, false), controlled_claim(stratified.att, outcome)]
    evidence = spark.createDataFrame([controlled_evidence(stratified, naive.estimate)], _EVIDENCE)
    found = violations(spark.createDataFrame(claims, _CLAIMS), evidence)
    counts = found.where("severity = 'critical'").groupBy(F.col("run_id").alias("method")).agg(F.count(F.lit(1)).alias("violations"))
    estimates = spark.createDataFrame(
        [("naive", naive.estimate, len(false)), ("stratified", stratified.att, 0)],
        "method string, estimate double, false_discoveries bigint",
    )
    return estimator_scoreboard([estimates.join(counts, "method", "left").fillna(0, ["violations"])], truth)
