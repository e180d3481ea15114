"""Queries for the claim audit, the rubric and ranked findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import audit, discovery, ledger, scoring
from plumbline.plans import cases
from plumbline.plans.ledger import _CHAINED, chained
from plumbline.plans.tables import table


def _inputs(spark, sf_dir):
    claims = cases.claims(spark, sf_dir)
    return claims, audit.citations(claims, cases.evidence(spark, sf_dir))


def claim_provenance(spark, sf_dir):
    return audit.check_provenance(*_inputs(spark, sf_dir))


def claim_numbers(spark, sf_dir):
    return audit.check_numbers(*_inputs(spark, sf_dir))


def document_numbers(spark, sf_dir):
    """Numbers written in the documents: the extraction behind the number check."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("run_id"), F.col("doc_id").alias("claim_id"), F.col("text").alias("summary"), F.lit("").alias("verdict")
    )
    numbers = audit.claim_numbers(docs)
    return numbers.groupBy(F.col("claim_id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("numbers"), F.count_if("percent").alias("percents"), F.max("value").alias("largest")
    )


def claim_columns(spark, sf_dir):
    return audit.check_columns(cases.claims(spark, sf_dir), cases.SCHEMA_COLUMNS)


def claim_causal(spark, sf_dir):
    return audit.check_causal(*_inputs(spark, sf_dir))


def claim_significance(spark, sf_dir):
    return audit.check_significance(*_inputs(spark, sf_dir))


def claim_fdr(spark, sf_dir):
    return audit.check_fdr(_inputs(spark, sf_dir)[1])


def claim_effect(spark, sf_dir):
    return audit.check_effect(*_inputs(spark, sf_dir))


def claim_direction(spark, sf_dir):
    return audit.check_direction(_inputs(spark, sf_dir)[1])


def claim_sample_size(spark, sf_dir):
    return audit.check_sample_size(*_inputs(spark, sf_dir))


def claim_leakage(spark, sf_dir):
    return audit.check_leakage(_inputs(spark, sf_dir)[1])


def claim_scope(spark, sf_dir):
    return audit.check_scope(_inputs(spark, sf_dir)[1])


def claim_vacuous(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("run_id"), F.col("doc_id").cast("string").alias("claim_id"), F.col("text").alias("summary"),
        F.lit("").alias("verdict"),
    )
    claims = cases.claims(spark, sf_dir).select("run_id", "claim_id", "summary", "verdict")
    return audit.check_vacuous(claims.unionByName(docs))


def claim_audit(spark, sf_dir):
    claims = cases.claims(spark, sf_dir)
    found = audit.violations(claims, cases.evidence(spark, sf_dir), cases.SCHEMA_COLUMNS)
    return audit.claim_audit(claims, found)


def fdr_family(spark, sf_dir):
    """All tests of one kind form a family."""
    result = discovery.fdr_family(cases.evidence(spark, sf_dir).select("run_id", "id", "kind", "test_name", "result"), ["test_name"])
    return result.select("run_id", "id", "test_name", "p", F.round("q", 6).alias("q"), "family_size")


def _rubric(spark, sf_dir):
    return scoring.evidence_rubric(cases.evidence(spark, sf_dir))


def evidence_rubric(spark, sf_dir):
    return _rubric(spark, sf_dir).withColumn("issues", F.array_join("issues", "; "))


def rigor_score(spark, sf_dir):
    return scoring.rigor_score(_rubric(spark, sf_dir))


def run_issues(spark, sf_dir):
    return scoring.run_issues(_rubric(spark, sf_dir))


def ranked_findings(spark, sf_dir):
    ranked = scoring.ranked_findings(cases.claims(spark, sf_dir))
    return ranked.select("run_id", "rank", "claim_id", "verdict", "confidence", F.round("score", 4).alias("score"))


def evidence_key_stats(spark, sf_dir):
    return scoring.key_statistics(cases.evidence(spark, sf_dir))


def findings_table(spark, sf_dir):
    return scoring.findings_table(cases.claims(spark, sf_dir), cases.evidence(spark, sf_dir))


def exportable_steps(spark, sf_dir):
    return ledger.exportable(chained(spark, sf_dir, "id", "code", "exportable")).select("run_id", "id", "code")


def audit_trail(spark, sf_dir):
    return ledger.audit_trail(chained(spark, sf_dir, "id", "kind", "produced_by", "status", "purpose"))


QUERIES = {
    f.__name__: f
    for f in (
        claim_provenance, claim_numbers, document_numbers, claim_columns, claim_causal, claim_significance, claim_fdr,
        claim_effect, claim_direction, claim_sample_size, claim_leakage, claim_scope, claim_vacuous, claim_audit, fdr_family,
        evidence_rubric, rigor_score, run_issues, ranked_findings, evidence_key_stats, findings_table, audit_trail, exportable_steps,
    )
}

_CITED = f"""WITH {cases.CLAIMS_SQL},
said AS (SELECT *, trim(summary || ' ' || verdict) AS text FROM claims),
refs AS (SELECT run_id, claim_id, text, unnest(list_distinct(evidence_ids)) AS id FROM said),
cited AS (SELECT r.run_id, r.claim_id, r.text, r.id, e.kind, e.test_name, e.code, e.params, e.result, e.id IS NOT NULL AS found
  FROM refs r LEFT JOIN evidence e ON e.run_id = r.run_id AND e.id = r.id)"""


def _rows(check: str, detail: str, source: str, where: str, severity: str = "critical", alias: str = "c") -> str:
    return f"""SELECT {alias}.run_id, {alias}.claim_id, '{check}' AS "check", CAST({detail} AS VARCHAR) AS detail,
      '{severity}' AS severity FROM {source} WHERE {where}"""


def _unsupported(check: str, says: str, supports: str) -> str:
    backed = f"SELECT 1 FROM cited x WHERE x.run_id = c.run_id AND x.claim_id = c.claim_id AND x.found AND ({supports})"
    return _rows(check, "NULL", "said c", f"({says}) AND NOT EXISTS ({backed})")


_SIGNIFICANT = "regexp_matches(text, '(?i)\\bsignificant(?:ly)?\\b')"
_P = "coalesce(result['p'], result['p_value'], result['pearson_p'], result['spearman_p'], result['adf_p_value'])"
_CAUSAL = r"(?i)\b(?:caused|causes|causing|proves|directly drives|drove|led to|results in)\b"
_LARGE = r"(?i)\b(?:large|strong|substantial|huge)\s+(?:effect|correlation|impact|relationship)\b"
_UP = r"regexp_matches(text, '(?i)\b(?:increased|higher|gain|growth|rose|positive)\b')"
_DOWN = r"regexp_matches(text, '(?i)\b(?:decreased|lower|loss|dropped|fell|negative)\b')"
_SIZE = r"regexp_extract(text, '(?i)\b(?:n\s*=\s*|sample\s+(?:size\s+)?(?:of\s+)?|across\s+)(\d+)\b', 1)"
_METRIC = "coalesce(result['diff'], result['mean_b'] - result['mean_a'], result['statistic'], result['pearson_r'], result['raw_effect'])"
_N = "coalesce(result['n'], result['num_rows'], result['n_a'])"
_NUMBER = r"\b\d[\d,]*(?:\.\d+)?(?:%|\b)"

_NUMBERS = rf""", nums AS (SELECT run_id, claim_id, unnest(regexp_extract_all(regexp_replace(text, '(?i)\b(?:ev_\d+|h\d+)\b', ' ', 'g'), '{_NUMBER}')) AS raw
  FROM said),
vals AS (SELECT *, CAST(regexp_replace(raw, '[,%]', '', 'g') AS DOUBLE) AS v, raw LIKE '%\%' ESCAPE '\' AS pct FROM nums),
leaf AS (SELECT run_id, claim_id, unnest(map_values(result)) AS t FROM cited WHERE found)"""
_NUMBER_ROWS = _rows(
    "numerical_exactness", "c.raw", "vals c",
    """c.v NOT IN (0, 1) AND EXISTS (SELECT 1 FROM cited x WHERE x.run_id = c.run_id AND x.claim_id = c.claim_id AND x.found)
      AND NOT EXISTS (SELECT 1 FROM leaf l WHERE l.run_id = c.run_id AND l.claim_id = c.claim_id AND
        (abs(c.v - abs(l.t)) <= greatest(abs(l.t) * 0.02, 0.01)
         OR abs(CASE WHEN c.pct THEN c.v / 100.0 ELSE c.v * 100.0 END - abs(l.t)) <= greatest(abs(l.t) * 0.02, 0.01)))""",
)

_KNOWN = ", ".join(f"'{c}'" for c in cases.SCHEMA_COLUMNS)
_TAUTOLOGY = "(?i)(?:revenue is correlated with revenue|data exists|nothing to report)"
_WORDS = r"(CASE WHEN c.text = '' THEN 0 ELSE len(regexp_split_to_array(c.text, '\s+')) END)"


def _vacuous(source: str) -> str:
    return _rows(
        "non_vacuous_check",
        f"CASE WHEN {_WORDS} < 3 THEN {_WORDS} || ' words' ELSE 'tautology' END",
        f"{source} c",
        f"{_WORDS} < 3 OR regexp_matches(c.text, '{_TAUTOLOGY}')",
    )


_CHECKS = {
    "claim_provenance": _rows("provenance_grounding", "NULL", "said c", "len(evidence_ids) = 0")
    + " UNION ALL "
    + _rows("provenance_grounding", "c.id", "cited c", "NOT found"),
    "claim_numbers": _NUMBER_ROWS,
    "claim_columns": _rows(
        "schema_integrity", "name", "(SELECT run_id, claim_id, unnest(columns) AS name FROM claims) c", f"name NOT IN ({_KNOWN})"
    ),
    "claim_causal": _unsupported(
        "causal_language_guard",
        f"regexp_matches(text, '{_CAUSAL}')",
        "test_name = 'controlled_association' AND result['attenuation_ratio'] > 0.7 AND result['vif_x'] < 5",
    ),
    "claim_significance": _unsupported("significance_check", _SIGNIFICANT, f"kind = 'stat_test' AND {_P} < 0.05"),
    "claim_fdr": _rows("fdr_check", "c.id", "cited c", f"{_SIGNIFICANT} AND kind = 'stat_test' AND result['q'] >= 0.05"),
    "claim_effect": _unsupported(
        "effect_size_check",
        f"regexp_matches(text, '{_LARGE}')",
        "abs(result['effect_size']) >= 0.8 OR abs(coalesce(result['pearson_r'], result['raw_effect'], result['spearman_r'])) >= 0.5",
    ),
    "claim_direction": _rows(
        "directionality_check", "c.id", "cited c",
        f"({_UP} AND NOT {_DOWN} AND {_METRIC} < -1e-6) OR ({_DOWN} AND NOT {_UP} AND {_METRIC} > 1e-6)",
    ),
    "claim_sample_size": _unsupported(
        "sample_size_check", f"{_SIZE} <> ''", f"abs(TRY_CAST({_SIZE} AS DOUBLE) - {_N}) <= greatest(1, {_N} * 0.05)"
    ),
    "claim_leakage": _rows(
        "data_leakage_check", "c.params['target']", "cited c",
        "kind = 'model' AND params['target'] <> '' AND list_contains(map_keys(result), 'feature_importance.' || params['target'])",
    ),
    "claim_scope": _rows(
        "scope_check", "c.id", "cited c",
        r"""found AND regexp_matches(text, '(?i)\bacross all\b|\bglobally\b|\buniversal\b')
          AND (upper(code) LIKE '%WHERE%' OR lower(CAST(params AS VARCHAR)) LIKE '%filter%')""",
        "warning",
    ),
    "claim_vacuous": _vacuous("said"),
}

_ALL = f"{_CITED}{_NUMBERS}, all_found AS ({' UNION ALL '.join(_CHECKS.values())})"

_DOCUMENTS = """, both_texts AS (SELECT run_id, claim_id, text FROM said
  UNION ALL SELECT source, CAST(doc_id AS VARCHAR), trim(text) FROM documents)"""

_RUBRIC = f"""WITH {cases.EVIDENCE_SQL},
g AS (SELECT *, coalesce(result['n'], result['n_a']) AS n, {_P.replace(", result['adf_p_value']", "")} AS p, result['q'] AS q,
  result['vif_x'] AS vif, abs(result['effect_size']) AS d, result['metrics.r2'] AS r2 FROM evidence),
i AS (SELECT *, CASE
  WHEN kind = 'stat_test' THEN list_filter([
    CASE WHEN n < 30 THEN 'rows_below_minimum: ' || CAST(n AS BIGINT) END,
    CASE WHEN n >= 30 AND n < 50 THEN 'rows_few: ' || CAST(n AS BIGINT) END,
    CASE WHEN p > 0.05 THEN printf('p_above_alpha: %.4f', p) END,
    CASE WHEN q > 0.05 THEN printf('q_above_limit: %.4f', q) END,
    CASE WHEN vif > 5 THEN printf('collinear_vif: %.2f', vif) END], lambda x: x IS NOT NULL)
  WHEN kind = 'model' THEN list_concat(
    CASE WHEN r2 < 0 THEN [printf('r2_below_limit: %.3f', r2)] ELSE [] END,
    list_transform(list_filter(list_sort(map_entries(result)), lambda e: e.key LIKE 'feature_importance.%' AND e.value >= 0.95),
      lambda e: 'feature_dominates: ' || substr(e.key, 20) || ' ' || printf('%.1f', e.value * 100) || '%'))
  WHEN kind = 'sql' AND result['num_rows'] = 0 THEN ['result_empty']
  ELSE [] END AS warned, CASE WHEN kind = 'stat_test' AND d < 0.2 THEN [printf('effect_tiny: %.3f', d)] ELSE [] END AS noted FROM g),
rubric AS (SELECT run_id, id AS evidence_id,
  CASE WHEN status = 'error' THEN 'failed' WHEN len(warned) > 0 THEN 'warning' ELSE 'pass' END AS rubric_status,
  CASE WHEN status = 'error' THEN 0.0 WHEN len(warned) > 0 THEN 0.7 ELSE 1.0 END::DOUBLE AS score,
  CASE WHEN status = 'error' THEN ['step_failed: ' || coalesce(error, 'no message')] ELSE list_concat(warned, noted) END AS issues FROM i)"""

_RANKED = f"""WITH {cases.CLAIMS_SQL}, sc AS (SELECT *,
  CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.3 ELSE 0.1 END::DOUBLE *
  CASE verdict WHEN 'supported' THEN 1.0 WHEN 'weak' THEN 0.5 WHEN 'refuted' THEN 0.3 WHEN 'insufficient' THEN 0.2 ELSE 0.1 END::DOUBLE AS score FROM claims),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, position) AS rank FROM sc)"""

_STATS = """, ks AS (SELECT run_id, id, kind, CASE
  WHEN kind = 'stat_test' THEN concat_ws(' | ', 'p ' || printf('%.4f', coalesce(result['p'], result['p_value'])),
    'effect ' || printf('%.3f', result['effect_size']),
    format('{:,}', CAST(coalesce(result['n'], result['n_a']) AS BIGINT)) || ' rows',
    'q ' || printf('%.4f', result['q']))
  WHEN kind = 'model' THEN 'r2 ' || printf('%.4f', result['metrics.r2']) || ' | rmse ' || printf('%.4f', result['metrics.rmse'])
  WHEN kind = 'sql' THEN format('{:,}', CAST(result['num_rows'] AS BIGINT)) || ' rows in the result' ELSE '' END AS key_statistics FROM evidence)"""

ORACLE = {name: f"{_CITED}{_NUMBERS if name == 'claim_numbers' else ''} {sql}" for name, sql in _CHECKS.items()} | {
    "claim_vacuous": f"{_CITED}{_DOCUMENTS} {_vacuous('both_texts')}",
    "document_numbers": rf"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(
        regexp_replace(trim(text), '(?i)\b(?:ev_\d+|h\d+)\b', ' ', 'g'), '{_NUMBER}')) AS raw FROM documents)
      SELECT doc_id, COUNT(*) AS numbers, COUNT(*) FILTER (WHERE right(raw, 1) = '%') AS percents,
        MAX(CAST(regexp_replace(raw, '[,%]', '', 'g') AS DOUBLE)) AS largest FROM n GROUP BY doc_id""",
    "claim_audit": f"""{_ALL} SELECT c.run_id, c.claim_id, COUNT(f.severity) FILTER (WHERE f.severity = 'critical') AS violations,
      COUNT(f.severity) FILTER (WHERE f.severity = 'warning') AS warnings,
      COUNT(f.severity) FILTER (WHERE f.severity = 'critical') = 0 AS passed
      FROM claims c LEFT JOIN all_found f ON f.run_id = c.run_id AND f.claim_id = c.claim_id GROUP BY 1, 2""",
    "fdr_family": f"""WITH {cases.EVIDENCE_SQL}, t AS (SELECT run_id, id, test_name, coalesce({_P}, 1.0) AS p FROM evidence WHERE kind = 'stat_test'),
      r AS (SELECT *, COUNT(*) OVER (PARTITION BY test_name) AS family_size, row_number() OVER (PARTITION BY test_name ORDER BY p) AS rank FROM t)
      SELECT run_id, id, test_name, p, ROUND(least(1.0, MIN(p * family_size / rank) OVER (PARTITION BY test_name ORDER BY p, rank
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q, family_size FROM r""",
    "evidence_rubric": f"{_RUBRIC} SELECT run_id, evidence_id, rubric_status, score, array_to_string(issues, '; ') AS issues FROM rubric",
    "rigor_score": f"""{_RUBRIC}, m AS (SELECT run_id, SUM(CAST(round(score * 10) AS BIGINT))::DOUBLE / (COUNT(*) * 10) AS mean,
      COUNT(*) AS total_evidences, CAST(SUM(len(issues)) AS BIGINT) AS issue_count FROM rubric GROUP BY run_id)
      SELECT run_id, CASE WHEN mean >= 0.85 THEN 'passed' WHEN mean >= 0.5 THEN 'warning' ELSE 'failed' END AS overall_status,
      floor(mean * 1000 + 0.5) / 1000 AS overall_score, total_evidences, issue_count FROM m""",
    "run_issues": f"""{_RUBRIC} SELECT run_id, evidence_id, CAST(generate_subscripts(issues, 1) AS INTEGER) AS position,
      unnest(issues) AS issue FROM rubric""",
    "ranked_findings": f"{_RANKED} SELECT run_id, rank, claim_id, verdict, confidence, ROUND(score, 4) AS score FROM ranked",
    "evidence_key_stats": f"WITH {cases.EVIDENCE_SQL}{_STATS} SELECT run_id, id, kind, coalesce(key_statistics, '') AS key_statistics FROM ks",
    "findings_table": f"""{_RANKED}{_STATS}, c AS (SELECT run_id, claim_id, unnest(evidence_ids) AS id, generate_subscripts(evidence_ids, 1) AS pos FROM claims),
      q AS (SELECT c.run_id, c.claim_id, string_agg(c.id || ': ' || key_statistics, '; ' ORDER BY pos) AS stats
        FROM c JOIN ks ON ks.run_id = c.run_id AND ks.id = c.id WHERE key_statistics <> '' GROUP BY 1, 2)
      SELECT r.run_id, r.rank, r.claim_id, r.verdict, r.confidence, coalesce(q.stats, '-') AS key_statistics
      FROM ranked r LEFT JOIN q ON q.run_id = r.run_id AND q.claim_id = r.claim_id""",
    "audit_trail": f"""{_CHAINED} SELECT h.run_id, h.id, h.kind, h.produced_by, h.seq AS execution_order, h.status,
      coalesce(h.purpose, '') AS purpose, substr(c.hash, 1, 12) || '...' AS short_hash
      FROM hashed h JOIN chain c ON h.run_id = c.run_id AND h.seq = c.seq""",
    "exportable_steps": f"""{_CHAINED} SELECT h.run_id, h.id, h.code FROM hashed h
      WHERE h.exportable AND h.code <> '' AND h.code NOT IN ('synthesis', 'report_synthesis', 'evaluator_threshold_checks')""",
}
