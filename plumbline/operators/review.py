"""One review from hypotheses to ranked findings.

Strings the operators together the way an analysis uses them: run the tests,
annotate their family with q-values, chain the results into the ledger, score
them, then audit and rank the claims written about them.  The claims are an
input table; nothing here writes text.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import DEFAULTS, Thresholds
from plumbline.operators import audit, discovery, ledger, scoring
from plumbline.operators.dispatch import Hypothesis, TestRegistry, default_registry
from plumbline.session import cut_lineage


@dataclass
class Review:
    evidence: DataFrame
    rubric: DataFrame
    rigor: DataFrame


@dataclass
class Conclusions:
    violations: DataFrame
    audit: DataFrame
    findings: DataFrame


@dataclass(frozen=True)
class Outcome:
    """What one tool found: its frame, the columns that name a row, and the columns that hold its numbers."""

    kind: str
    produced_by: str
    code: str
    frame: DataFrame
    keys: tuple[str, ...]
    values: tuple[str, ...]
    columns: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)


def as_result(outcome: Outcome) -> DataFrame:
    """The rows of an outcome as one JSON object: names of the rows to objects of their values.

    An outcome has a row per column, check or segment, not per row of the data.
    """
    frame = outcome.frame
    name = F.concat_ws("/", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("-")) for k in outcome.keys]) if outcome.keys else F.lit("all")
    rows = frame.select(name.alias("name"), F.struct(*[F.col(f"`{v}`") for v in outcome.values]).alias("own"))
    gathered = rows.groupBy("name").agg(F.first("own").alias("own")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "own")))).alias("result"))
    return gathered.select(F.to_json(F.coalesce("result", F.create_map().cast(gathered.schema["result"].dataType))).alias("result"))


def tool_evidence(
    spark, outcomes: list[Outcome], run_id: str, dataset_hash: str, created_at: dt.datetime, start: int = 1
) -> DataFrame:
    """Outcomes of any tools as an unchained evidence batch, in their order, with nested results as JSON."""
    rows = []
    for i, outcome in enumerate(outcomes, start):
        params = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(str(v))) for k, v in outcome.params.items()])) if outcome.params else F.create_map()
        rows.append(
            as_result(outcome).select(
                F.lit(run_id).alias("run_id"),
                F.lit(i).cast("bigint").alias("seq"),
                F.lit(outcome.kind).alias("kind"),
                F.lit(outcome.produced_by).alias("produced_by"),
                F.lit("").alias("test_name"),
                F.lit(outcome.code).alias("code"),
                params.cast("map<string,string>").alias("params"),
                "result",
                F.array(*[F.lit(c) for c in outcome.columns]).cast("array<string>").alias("columns"),
                F.array(*[ledger.evidence_id(F.lit(i - 1))] * (i > 1)).cast("array<string>").alias("depends_on"),
                F.lit(dataset_hash).alias("dataset_hash"),
                F.lit("ok").alias("status"),
                F.lit(None).cast("string").alias("error"),
                F.lit(outcome.code).alias("purpose"),
                F.lit(True).alias("exportable"),
                F.lit(created_at).cast("timestamp_ntz").alias("created_at"),
            )
        )
    return reduce(DataFrame.unionByName, rows)


def with_flat_results(evidence: DataFrame) -> DataFrame:
    """Evidence whose JSON results are maps of numbers, as the audit and the rubric read them."""
    return evidence.withColumn("result", audit.numeric_leaves(F.col("result")))


def as_evidence(
    results: DataFrame, hypotheses: list[Hypothesis], run_id: str, dataset_hash: str, created_at: dt.datetime
) -> DataFrame:
    """Test results as an unchained evidence batch, in the order of the hypotheses.

    One row per hypothesis.  Each row depends on the one before it.
    """
    spark = results.sparkSession
    order = spark.createDataFrame(
        [(i, h.id, h.columns()) for i, h in enumerate(hypotheses, 1)], "seq bigint, hypothesis_id string, columns array<string>"
    )
    tests = results.withColumns({"run_id": F.lit(run_id), "kind": F.lit("stat_test")})
    q = discovery.fdr_family(tests.where("status = 'ok'"), ["run_id"]).select("hypothesis_id", "q")
    joined = results.join(order, "hypothesis_id").join(q, "hypothesis_id", "left")
    with_q = F.when(F.col("q").isNotNull(), F.map_concat("result", F.create_map(F.lit("q"), F.col("q")))).otherwise(F.col("result"))
    earlier = F.when(F.col("seq") > 1, F.array(ledger.evidence_id(F.col("seq") - 1))).otherwise(F.array().cast("array<string>"))
    return joined.select(
        F.lit(run_id).alias("run_id"),
        "seq",
        F.lit("stat_test").alias("kind"),
        F.lit("stats_agent").alias("produced_by"),
        "test_name",
        F.col("test_name").alias("code"),
        F.create_map(F.lit("hypothesis_id"), F.col("hypothesis_id")).alias("params"),
        with_q.alias("result"),
        "columns",
        earlier.alias("depends_on"),
        F.lit(dataset_hash).alias("dataset_hash"),
        "status",
        "error",
        F.concat(F.lit("test of "), "hypothesis_id").alias("purpose"),
        (F.col("status") == "ok").alias("exportable"),
        F.lit(created_at).cast("timestamp_ntz").alias("created_at"),
    )


def review(
    df: DataFrame,
    hypotheses: list[Hypothesis],
    run_id: str,
    dataset_hash: str,
    created_at: dt.datetime,
    registry: TestRegistry | None = None,
    thresholds: Thresholds = DEFAULTS,
) -> Review:
    """Run the tests and return chained evidence with its scores."""
    results = cut_lineage((registry or default_registry()).run(df, hypotheses))
    batch = cut_lineage(as_evidence(results, hypotheses, run_id, dataset_hash, created_at))
    chained = cut_lineage(ledger.ledger_append(batch))
    rubric = scoring.evidence_rubric(chained, thresholds)
    return Review(chained, rubric, scoring.rigor_score(rubric, thresholds))


def conclude(
    claims: DataFrame, evidence: DataFrame, schema_columns: list[str] | None = None, thresholds: Thresholds = DEFAULTS
) -> Conclusions:
    """Audit the claims against the evidence and rank them."""
    found = cut_lineage(audit.violations(claims, evidence, schema_columns, thresholds))
    return Conclusions(found, audit.claim_audit(claims, found), scoring.findings_table(claims, evidence))
