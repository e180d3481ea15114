"""Queries for nested results: leaves of JSON, differences by path, templates with paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.operators import nested, replay
from plumbline.plans.tables import table


def json_leaves(spark, sf_dir):
    """Every scalar of every event, written as one nested document."""
    events = table(spark, sf_dir, "events")
    document = F.format_string(
        '{"event":{"type":"%s","props":%s},"by":[%d,{"at":null}],"value":%s}',
        F.col("event_type"), F.col("props"), F.col("user_id"), F.col("value").cast("decimal(18,2)").cast("string"),
    )
    parsed = events.select("event_id", F.explode(nested.leaves(F.try_parse_json(document))).alias("leaf"))
    value = F.col("leaf.value")
    named = F.when(nested.is_number(value), "number").otherwise(F.lower(nested.kind(value)))
    return parsed.select("event_id", F.col("leaf.path").alias("path"), named.alias("kind"), nested.as_number(value).alias("number"), F.try_variant_get(value, "$", "string").alias("said")).withColumn(
        "said", F.when(F.col("kind") == "string", F.col("said"))
    )


def _money(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)").cast("string")


def account_results(spark, sf_dir):
    """One result per customer, as the JSON text that a tool returns."""
    result = F.format_string(
        '{"segment":{"name":"%s","balance":%s},"keys":[%d,%d],"debt":%s}',
        F.col("c_mktsegment"), _money("c_acctbal"), F.col("c_custkey"), F.col("c_nationkey"), (F.col("c_acctbal") < 0).cast("string"),
    )
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("run_"), F.col("c_custkey").cast("string")).alias("run_id"), F.lit("ev_0001").alias("id"), F.lit("ok").alias("status"),
        result.alias("result"), F.format_string('{"alpha":0.05,"by":"%s"}', F.col("c_mktsegment")).alias("params"), "c_custkey",
    )


def nested_diff(spark, sf_dir):
    """Results against a second execution that changed, lost, added or spoilt some."""
    digit, text = F.col("c_custkey") % 10, F.col("result")
    again = (
        F.when(digit == 0, F.regexp_replace(text, '"keys":\\[\\d+', '"keys":[-1'))
        .when(digit == 1, F.regexp_replace(text, ',"debt":\\w+', ""))
        .when(digit == 2, F.regexp_replace(text, '"name":"([A-Z]+)"', '"name":["$1"]'))
        .when(digit == 3, F.regexp_replace(text, '"balance":([-0-9.]+)', '"balance": $1e0'))
        .when(digit == 4, F.substring(text, 1, 20))
        .when(digit == 5, F.regexp_replace(text, "}$", ',"more":{"x":1.5}}'))
        .otherwise(text)
    )
    results = account_results(spark, sf_dir)
    return replay.nested_diff(results, results.withColumn("result", again))


def nested_templates(spark, sf_dir):
    results = account_results(spark, sf_dir)
    digit = F.col("c_custkey") % 10
    text = (
        F.when(digit == 0, "{ev_0001.result.segment.name:.1f}")
        .when(digit == 1, "{ev_0001.result.segment.missing}")
        .when(digit == 2, "Segment {ev_0001.result.segment}")
        .when(digit == 3, "{ev_0001.result.keys}")
        .otherwise("{ev_0001.result.segment.name:s} holds {ev_0001.result.segment.balance:,.2f}, in debt: {ev_0001.result.debt} at {ev_0001.params.alpha:.1%}")
    )
    broken = F.when(digit == 4, F.substring("result", 1, 30)).otherwise(F.col("result"))
    templates = results.select("run_id", F.lit("t").alias("template_id"), text.alias("text"))
    return replay.resolve_templates(templates, results.withColumn("result", broken))


QUERIES = {f.__name__: f for f in (json_leaves, nested_diff, nested_templates)}

_BALANCE = "regexp_replace(CAST(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS VARCHAR), '\\.0$', '')"

ORACLE = {
    "json_leaves": """SELECT event_id, 'event.type' AS path, 'string' AS kind, CAST(NULL AS DOUBLE) AS number, event_type AS said FROM events
      UNION ALL SELECT event_id, 'event.props.k', 'number', CAST(json_extract(props, '$.k') AS DOUBLE), NULL FROM events
      UNION ALL SELECT event_id, 'by.0', 'number', CAST(user_id AS DOUBLE), NULL FROM events
      UNION ALL SELECT event_id, 'by.1.at', 'void', NULL, NULL FROM events
      UNION ALL SELECT event_id, 'value', 'number', CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE), NULL FROM events""",
    "nested_diff": f"""WITH c AS (SELECT 'run_' || c_custkey AS run_id, 'ev_0001' AS id, c_custkey % 10 AS d, * FROM customer)
      SELECT run_id, id, 'keys.0' AS key, CAST(c_custkey AS VARCHAR) AS expected, '-1' AS actual, 'mismatch' AS reason FROM c WHERE d = 0
      UNION ALL SELECT run_id, id, 'debt', CASE WHEN c_acctbal < 0 THEN 'true' ELSE 'false' END, NULL, 'missing_in_actual' FROM c WHERE d = 1
      UNION ALL SELECT run_id, id, 'segment.name', '"' || c_mktsegment || '"', NULL, 'missing_in_actual' FROM c WHERE d = 2
      UNION ALL SELECT run_id, id, 'segment.name.0', NULL, '"' || c_mktsegment || '"', 'missing_in_expected' FROM c WHERE d = 2
      UNION ALL SELECT run_id, id, NULL, NULL, NULL, 'malformed_actual' FROM c WHERE d = 4
      UNION ALL SELECT run_id, id, 'more.x', NULL, '1.5', 'missing_in_expected' FROM c WHERE d = 5""",
    "nested_templates": f"""WITH c AS (SELECT 'run_' || c_custkey AS run_id, 't' AS template_id, c_custkey % 10 AS d,
        CASE c_custkey % 10 WHEN 0 THEN 'not_a_number' WHEN 1 THEN 'unknown_path' WHEN 4 THEN 'malformed_json' END AS error, * FROM customer)
      SELECT run_id, template_id, CASE WHEN error IS NOT NULL THEN NULL
        WHEN d = 2 THEN 'Segment {{"balance":' || {_BALANCE} || ',"name":"' || c_mktsegment || '"}}'
        WHEN d = 3 THEN '[' || c_custkey || ',' || c_nationkey || ']'
        ELSE c_mktsegment || ' holds ' || format('{{:,.2f}}', c_acctbal) || ', in debt: ' || CASE WHEN c_acctbal < 0 THEN 'True' ELSE 'False' END || ' at 5.0%' END AS resolved,
        CASE WHEN error IS NULL THEN 'ok' ELSE 'unresolved' END AS status, error FROM c""",
}
