"""Evidence and claims derived from the orders table.

Every customer is one run: a plan, a validation, one query per order year,
three tests, a model and the closing steps.  Claims are sentences over that
evidence, some of them wrong on purpose.  The same SELECT runs on Spark and on
DuckDB; only the spelling of arrays, maps and list functions differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans.tables import table


class SparkSpelling:
    timestamp = "TIMESTAMP_NTZ"
    orders = "{orders}"
    # Places follow from the years of a customer, so that wide rows need not be sorted for their numbers.
    per_customer, per_year = ", ny, CAST(NULL AS INT) AS place", ", ny, place"
    ranked_years = """(SELECT *, row_number() OVER (PARTITION BY ck ORDER BY y) AS place, COUNT(*) OVER (PARTITION BY ck) AS ny FROM years)"""
    numbered = "SELECT *, {seq} AS seq, ny + {others} AS len FROM nodes"

    @staticmethod
    def array(*items: str) -> str:
        return f"array({', '.join(items)})" if items else "CAST(array() AS array<string>)"

    @classmethod
    def map(cls, entries: dict[str, str], value_type: str) -> str:
        values = cls.array(*[f"CAST({v} AS {value_type})" for v in entries.values()])
        return f"map_from_arrays({cls.array(*entries)}, {values})"

    @staticmethod
    def explode(*items: str) -> str:
        return f"explode(array({', '.join(items)}))"

    @staticmethod
    def earlier_ids() -> str:
        return "transform(sequence(1, CAST(seq AS INT) - 1), i -> 'ev_' || lpad(CAST(i AS STRING), 4, '0'))"


class DuckSpelling:
    timestamp = "TIMESTAMP"
    orders = "orders"
    per_customer = per_year = ""
    ranked_years = "years"
    numbered = "SELECT *, row_number() OVER (PARTITION BY ck ORDER BY slot) AS seq, COUNT(*) OVER (PARTITION BY ck) AS len FROM nodes"

    @staticmethod
    def array(*items: str) -> str:
        return f"CAST([{', '.join(items)}] AS VARCHAR[])"

    @classmethod
    def map(cls, entries: dict[str, str], value_type: str) -> str:
        values = ", ".join(f"CAST({v} AS {value_type})" for v in entries.values())
        return f"map([{', '.join(entries)}], [{values}])"

    @staticmethod
    def explode(*items: str) -> str:
        return f"unnest([{', '.join(items)}])"

    @staticmethod
    def earlier_ids() -> str:
        return "list_transform(range(1, seq), lambda i: 'ev_' || lpad(CAST(i AS STRING), 4, '0'))"


def _half_up(expression: str, digits: int) -> str:
    scale = f"1e{digits}"
    return f"(CAST(floor(({expression}) * {scale} + 0.5e0) AS DOUBLE) / {scale})"


def _text(expression: str, digits: int = 2) -> str:
    return f"CAST(CAST({expression} AS DECIMAL(18,{digits})) AS STRING)"


def _id(seq: str) -> str:
    return f"'ev_' || lpad(CAST({seq} AS STRING), 4, '0')"


def _statistics(s) -> str:
    """CTEs ``years`` and ``stat``: per customer and year, and per customer."""
    split = f"{s.timestamp} '1998-07-01 00:00:00'"
    return f"""ord AS (SELECT o_custkey AS ck, year(o_orderdate) AS y, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderdate AS d
  FROM {s.orders}),
years AS (SELECT ck, y, COUNT(*) AS n, SUM(price) AS total, MAX(d) AS last_d,
  SUM(CASE WHEN d < {split} THEN 1 ELSE 0 END) AS na, SUM(CASE WHEN d >= {split} THEN 1 ELSE 0 END) AS nb,
  SUM(CASE WHEN d < {split} THEN price END) AS sa, SUM(CASE WHEN d >= {split} THEN price END) AS sb
  FROM ord GROUP BY ck, y),
cust AS (SELECT ck, COUNT(*) AS ny, CAST(SUM(n) AS DOUBLE) AS n, MAX(last_d) AS last_d, CAST(SUM(na) AS DOUBLE) AS na,
  CAST(SUM(nb) AS DOUBLE) AS nb, CAST(SUM(sa) AS DOUBLE) AS sa, CAST(SUM(sb) AS DOUBLE) AS sb FROM years GROUP BY ck),
means AS (SELECT *, {_half_up('sa / nullif(na, 0e0)', 2)} AS mean_a, {_half_up('sb / nullif(nb, 0e0)', 2)} AS mean_b FROM cust),
diffs AS (SELECT *, {_half_up('mean_b - mean_a', 2)} AS diff, {_half_up('(mean_b - mean_a) / 1e5', 3)} AS effect,
  (mean_b - mean_a) / (12e4 * sqrt(1e0 / nullif(na, 0e0) + 1e0 / nullif(nb, 0e0))) AS z FROM means),
stat AS (SELECT *, {_half_up('2e0 / (1e0 + exp(1.702e0 * abs(z)))', 3)} AS p, {_half_up('z / (1e0 + abs(z))', 3)} AS r,
  CAST(4 + ck % 7 AS DOUBLE) / 1e1 AS att, 1e0 + CAST(ck % 13 AS DOUBLE) / 2e0 AS vif,
  CAST(ck % 23 - 2 AS DOUBLE) / 2e1 AS r2, {_half_up('CAST(ck % 41 AS DOUBLE) / 4e1', 3)} AS share FROM diffs)"""


# Slots of a run in order; the queries of the years lie between 2 and 30.
_SLOTS = (1, 2, 30, 31, 32, 40, 50, 51, 52)


def _case(entries: dict[int, str], otherwise: str) -> str:
    return "CASE slot " + " ".join(f"WHEN {k} THEN {v}" for k, v in entries.items()) + f" ELSE {otherwise} END"


def _seq() -> str:
    """The place of a row in its run: slots below 10 come before the years, the others after them."""
    early = sum(slot < 10 for slot in _SLOTS)
    places = {slot: str(i) if slot < 10 else f"ny + {i}" for i, slot in enumerate(_SLOTS, 1)}
    return f"CASE WHEN place IS NOT NULL THEN {early} + place ELSE {_case(places, 'NULL')} END"


def evidence_select(s) -> str:
    """WITH list ending in ``evidence`` (content columns, numbered from 1 per run)."""
    number, text = "DOUBLE", "STRING"
    results = {
        1: s.map({"'steps'": "9"}, number),
        2: s.map({"'null_rate'": "0", "'duplicates'": "0"}, number),
        30: s.map(
            {"'p'": "p", "'q'": _half_up("least(1e0, p * 1.5e0)", 3), "'n'": "n", "'n_a'": "na", "'mean_a'": "mean_a",
             "'mean_b'": "mean_b", "'diff'": "diff", "'effect_size'": "effect"}, number),
        31: s.map(
            {"'p_value'": "p", "'raw_effect'": "r", "'controlled_effect'": _half_up("r * att", 3),
             "'attenuation_ratio'": "att", "'vif_x'": "vif", "'n'": "n"}, number),
        32: s.map({"'pearson_r'": "r", "'pearson_p'": "p", "'n'": "n"}, number),
        40: s.map(
            {"'metrics.r2'": "r2", "'metrics.rmse'": _half_up("abs(1e0 - r2)", 3), "'feature_importance.month'": "share",
             "'feature_importance.' || CASE WHEN ck % 9 = 0 THEN 'o_totalprice' ELSE 'segment' END": _half_up("1e0 - share", 3),
             "'n_samples'": "n"}, number),
    }
    params = {
        30: s.map({"'effect_kind'": "'d'", "'hypothesis_id'": "'H1'"}, text),
        31: s.map({"'controls'": "'o_orderpriority'", "'hypothesis_id'": "'H3'"}, text),
        40: s.map({"'target'": "'o_totalprice'", "'task'": "'regression'"}, text),
    }
    none = s.map({"'hypothesis_id'": "''"}, text)
    columns = {
        1: s.array("'o_custkey'"),
        2: s.array("'o_totalprice'", "'o_orderdate'"),
        31: s.array("'o_totalprice'", "'o_orderpriority'"),
        40: s.array("'o_totalprice'", "'o_orderdate'", "'o_orderkey'"),
        50: s.array(), 51: s.array(), 52: s.array(),
    }
    kinds = {1: "'plan'", 2: "'validation'", 40: "'model'", 50: "'analysis'", 51: "'evaluation'", 52: "'report'"}
    makers = {1: "'planner'", 2: "'system'", 40: "'ml_agent'", 50: "'analyst'", 51: "'evaluator'", 52: "'report_agent'"}
    tests = {30: "'before_after'", 31: "'controlled_association'", 32: "'association'"}
    codes = {
        1: "''", 2: "'check_nulls'", 30: "'compare order value'", 31: "'order value given priority'", 32: "'order value by year'",
        40: "'gradient_boosting'", 50: "'synthesis'", 51: "'evaluator_threshold_checks'", 52: "'report_synthesis'",
    }
    broken = "slot = 30 AND (na = 0 OR nb = 0)"
    return f"""{_statistics(s)},
slots AS (SELECT stat.*, {s.explode(*map(str, _SLOTS))} AS slot FROM stat),
nodes AS (
  SELECT ck, slot, {_case(kinds, "'stat_test'")} AS kind, {_case(makers, "'stats_agent'")} AS produced_by,
    {_case(tests, "''")} AS test_name, {_case(codes, "''")} AS code, {_case(params, none)} AS params,
    {_case(results, s.map({"'steps'": "1"}, number))} AS result, {_case(columns, s.array("'o_totalprice'", "'o_orderdate'"))} AS columns,
    CASE WHEN {broken} THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN {broken} THEN 'too few rows' END AS error,
    'step ' || CAST(slot AS STRING) || ' of the review of customer ' || CAST(ck AS STRING) AS purpose,
    slot IN (30, 31, 32, 40) AS exportable, last_d AS created_at{s.per_customer}
  FROM slots
  UNION ALL
  SELECT ck, 10 + y - 1990 AS slot, 'sql' AS kind, 'sql_agent' AS produced_by, '' AS test_name,
    CASE WHEN ck % 2 = 0 THEN 'SELECT avg(o_totalprice) FROM orders WHERE o_custkey = ' || CAST(ck AS STRING)
      ELSE 'SELECT avg(o_totalprice) FROM customer_orders' END AS code,
    {none} AS params,
    {s.map({"'num_rows'": "CASE WHEN ck % 29 = 0 THEN 0 ELSE n END", "'mean'": _half_up('CAST(total AS DOUBLE) / n', 2)}, number)} AS result,
    {s.array("'o_totalprice'", "'o_custkey'")} AS columns, 'ok' AS status, CAST(NULL AS STRING) AS error,
    'orders of ' || CAST(y AS STRING) AS purpose, true AS exportable, last_d AS created_at{s.per_year}
  FROM {s.ranked_years}),
numbered AS ({s.numbered.format(seq=_seq(), others=len(_SLOTS))}),
evidence AS (SELECT 'run_' || CAST(ck AS STRING) AS run_id, CAST(seq AS BIGINT) AS seq, {_id('seq')} AS id, kind, produced_by,
  test_name, code, params, result, columns,
  CASE WHEN slot = 1 THEN {s.array()} WHEN slot >= 50 THEN {s.earlier_ids()}
    WHEN slot = 40 THEN {s.array(_id('seq - 1'))} WHEN slot >= 30 THEN {s.array(_id('len - 7'))}
    WHEN slot >= 10 THEN {s.array("'ev_0002'")} ELSE {s.array("'ev_0001'")} END AS depends_on,
  status, error, purpose, exportable, created_at, sha256_of_segment AS dataset_hash
  FROM (SELECT numbered.*, {'sha2' if s is SparkSpelling else 'sha256'}('orders-' || CAST(ck % 5 AS STRING){', 256' if s is SparkSpelling else ''}) AS sha256_of_segment FROM numbered) x)"""


def claims_select(s) -> str:
    """WITH list ending in ``claims``; needs ``stat`` from the evidence list."""
    test, controlled, linear, model = (_id(f"2 + ny + {k}") for k in (1, 2, 3, 4))
    unknown = "'unknown'"
    rises = "(diff >= 0) <> (ck % 7 = 0)"
    mean_text = f"coalesce({_text(_half_up('mean_b * CASE WHEN ck % 5 = 0 THEN 1.5e0 ELSE 1e0 END', 2))}, {unknown})"
    count_text = "CAST(CAST(n + CASE WHEN ck % 6 = 0 THEN 40 ELSE 0 END AS BIGINT) AS STRING)"
    summaries = {
        1: f"'Average order value ' || CASE WHEN {rises} THEN 'rose' ELSE 'fell' END || ' to ' || {mean_text} || ' across ' || {count_text} || ' orders'",
        2: f"'The change in order value is significant with p = ' || coalesce({_text('p', 3)}, {unknown}) || ' as H2 expected'",
        3: "'Late ordering ' || CASE WHEN ck % 3 = 0 THEN 'is associated with' ELSE 'caused' END || ' a ' || CASE WHEN ck % 2 = 0 THEN 'large effect' ELSE 'moderate shift' END || ' on order value'",
        4: f"CASE WHEN ck % 10 = 0 THEN 'data exists' WHEN ck % 10 = 1 THEN 'ok' ELSE 'The model explains ' || {_text('r2 * 100', 0)} || '% of order value' END",
        5: "'Mean order value had steady growth across all segments'",
    }
    verdicts = {1: "'supported'", 2: "'weak'", 3: "CASE WHEN ck % 4 = 0 THEN 'refuted' ELSE 'supported' END", 4: "''", 5: "'insufficient'"}
    confidences = {1: "'high'", 2: "'medium'", 3: "'high'", 4: "'low'", 5: "'uncertain'"}
    cited = {
        1: f"CASE WHEN ck % 13 = 0 THEN {s.array()} WHEN ck % 11 = 0 THEN {s.array(test, chr(39) + 'ev_9999' + chr(39))} ELSE {s.array(test)} END",
        2: s.array(test, linear),
        3: s.array(controlled),
        4: s.array(model),
        5: s.array("'ev_0003'"),
    }
    columns = {
        4: f"CASE WHEN ck % 8 = 0 THEN {s.array(chr(39) + 'o_totalprice' + chr(39), chr(39) + 'o_discount' + chr(39))} ELSE {s.array(chr(39) + 'o_totalprice' + chr(39))} END",
    }
    return f"""claim_slots AS (SELECT stat.*, {s.explode('1', '2', '3', '4', '5')} AS slot FROM stat),
claims AS (SELECT 'run_' || CAST(ck AS STRING) AS run_id, slot AS position, 'H' || CAST(slot AS STRING) AS claim_id,
  {_case(summaries, "''")} AS summary, {_case(verdicts, "''")} AS verdict, {_case(confidences, "''")} AS confidence,
  {_case(cited, s.array())} AS evidence_ids, {_case(columns, s.array("'o_totalprice'", "'o_orderdate'"))} AS columns
  FROM claim_slots)"""


SCHEMA_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

EVIDENCE_SQL = evidence_select(DuckSpelling)
CLAIMS_SQL = f"{EVIDENCE_SQL}, {claims_select(DuckSpelling)}"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = f"WITH {evidence_select(SparkSpelling)} SELECT * FROM evidence"
    return spark.sql(query, orders=table(spark, sf_dir, "orders"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = f"WITH {_statistics(SparkSpelling)}, {claims_select(SparkSpelling)} SELECT * FROM claims"
    return spark.sql(query, orders=table(spark, sf_dir, "orders"))
