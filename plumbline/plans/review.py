"""Queries for whole reviews: evidence of tests and of other tools, and prompts of later turns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumbline.operators import ledger, sessions
from plumbline.operators.review import Outcome, review, tool_evidence as evidence_of_tools, with_flat_results
from plumbline.plans import explore, statistics
from plumbline.plans.tables import table

_NOW = dt.datetime(2024, 5, 1)
_HASH = "0" * 64


def review_evidence(spark, sf_dir):
    """The hypotheses about line items as chained evidence with q-values over their family."""
    done = review(table(spark, sf_dir, "lineitem"), statistics.HYPOTHESES, "run_1", _HASH, _NOW)
    verdict = ledger.ledger_verify(done.evidence).select("run_id", "chain_valid")
    result = F.col("result")
    p = F.coalesce(*[result[k] for k in ("p", "p_value", "pearson_p", "adf_p_value")])
    return done.evidence.join(verdict, "run_id").select(
        "id", F.col("params")["hypothesis_id"].alias("hypothesis_id"), "test_name", "status", "exportable", "chain_valid",
        F.round(p, 4).alias("p"), F.round(result["q"], 3).alias("q"),
    )


def _outcomes(spark, sf_dir):
    return [
        Outcome("validation", "quality", "check_nulls", explore.check_nulls(spark, sf_dir), ("column",), ("value",)),
        Outcome("analysis", "explore", "top_segments", explore.top_segments(spark, sf_dir), ("segment", "label"), ("rank", "value"), ("o_totalprice",), {"top": 5}),
        Outcome("analysis", "explore", "revenue_decomposition", explore.revenue_decomposition(spark, sf_dir), ("c_mktsegment",), ("delta_revenue", "customer_effect")),
    ]


def tool_evidence(spark, sf_dir):
    """Checks, segments and the decomposition as chained evidence, by the numbers of their nested results."""
    chained = ledger.ledger_append(evidence_of_tools(spark, _outcomes(spark, sf_dir), "run_1", _HASH, _NOW))
    flat = with_flat_results(chained).select("id", "kind", "code", F.array_join("depends_on", ",").alias("depends_on"), F.explode("result").alias("key", "value"))
    return flat.withColumn("value", F.round("value", 2))


def turn_prompts(spark, sf_dir):
    """The last question of every conversation after all that was asked and answered before."""
    messages = table(spark, sf_dir, "conversations")
    questions = messages.where("role <> 'assistant'").select("conv_id", "turn", F.col("text").alias("question"))
    answers = messages.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("finding"))
    turns = questions.join(answers, ["conv_id", "turn"], "left").withColumnRenamed("conv_id", "session_id")
    asked = questions.groupBy(F.col("conv_id").alias("session_id")).agg(F.max("turn").alias("turn"), F.max_by("question", "turn").alias("question"))
    return sessions.turn_prompts(sessions.context_lines(turns), asked)


QUERIES = {f.__name__: f for f in (review_evidence, tool_evidence, turn_prompts)}

ORACLE = {
    "review_evidence": f"""WITH h AS ({statistics.ORACLE['run_hypotheses']}),
      t AS (SELECT hypothesis_id, MAX(test_name) AS test_name, MAX(status) AS status,
        MAX(value) FILTER (WHERE key IN ('p', 'p_value', 'pearson_p', 'adf_p_value')) AS p FROM h GROUP BY 1),
      r AS (SELECT *, CASE WHEN p IS NOT NULL THEN p * COUNT(p) OVER () / row_number() OVER (ORDER BY p NULLS LAST) END AS raw FROM t)
      SELECT 'ev_000' || substr(hypothesis_id, 2) AS id, hypothesis_id, test_name, status, status = 'ok' AS exportable, true AS chain_valid, ROUND(p, 4) AS p,
        ROUND(CASE WHEN p IS NOT NULL THEN least(1.0, MIN(raw) OVER (ORDER BY p NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END, 3) AS q FROM r""",
    "tool_evidence": f"""WITH n AS ({explore.ORACLE['check_nulls']}), s AS ({explore.ORACLE['top_segments']}), d AS ({explore.ORACLE['revenue_decomposition']})
      SELECT 'ev_0001' AS id, 'validation' AS kind, 'check_nulls' AS code, '' AS depends_on, "column" || '.value' AS key, ROUND(value, 2) AS value FROM n
      UNION ALL SELECT 'ev_0002', 'analysis', 'top_segments', 'ev_0001', segment || '/' || label || '.rank', rank FROM s
      UNION ALL SELECT 'ev_0002', 'analysis', 'top_segments', 'ev_0001', segment || '/' || label || '.value', ROUND(value, 2) FROM s
      UNION ALL SELECT 'ev_0003', 'analysis', 'revenue_decomposition', 'ev_0002', c_mktsegment || '.delta_revenue', delta_revenue FROM d
      UNION ALL SELECT 'ev_0003', 'analysis', 'revenue_decomposition', 'ev_0002', c_mktsegment || '.customer_effect', customer_effect FROM d""",
    "turn_prompts": """WITH q AS (SELECT conv_id, turn, text FROM conversations WHERE role <> 'assistant'),
      l AS (SELECT q.conv_id, q.turn, 'asked ' || q.text || ' | found ' || coalesce(a.text, '') AS line
        FROM q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'),
      z AS (SELECT conv_id, MAX(turn) AS turn, arg_max(text, turn) AS text FROM q GROUP BY 1),
      c AS (SELECT z.conv_id, string_agg(line, chr(10) ORDER BY l.turn) AS context FROM z JOIN l ON l.conv_id = z.conv_id AND l.turn < z.turn GROUP BY 1)
      SELECT z.conv_id AS session_id, z.turn, CASE WHEN context IS NULL THEN z.text ELSE 'Known so far' || chr(10) || context || chr(10) || 'Now asked' || chr(10) || z.text END AS prompt
      FROM z LEFT JOIN c ON c.conv_id = z.conv_id""",
}
