import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import audit, scoring

EVIDENCE_SCHEMA = (
    "run_id string, id string, kind string, test_name string, code string, params map<string,string>, "
    "result map<string,double>, status string, error string"
)
CLAIM_SCHEMA = "run_id string, claim_id string, summary string, verdict string, evidence_ids array<string>, columns array<string>"
TEST = {"p": 0.004, "q": 0.009, "n": 120.0, "effect_size": 0.9, "diff": 17.5, "statistic": 3.6}
MODEL = {"metrics.r2": 0.7, "feature_importance.tenure": 0.4, "feature_importance.usage": 0.6}
SCHEMA_COLUMNS = ["revenue", "tenure", "usage", "churn"]


def _row(id_, kind="stat_test", result=None, params=None, code="", test_name="before_after", status="ok"):
    return ("r", id_, kind, test_name, code, params or {}, TEST if result is None else result, status, None)


BASE = [_row("ev_0001"), _row("ev_0002", "model", MODEL, {"target": "churn"})]


def _audit(spark, claims, evidence=BASE, columns=SCHEMA_COLUMNS, **kw):
    frame = spark.createDataFrame([("r", *c) for c in claims], CLAIM_SCHEMA)
    return audit.violations(frame, spark.createDataFrame(evidence, EVIDENCE_SCHEMA), columns, **kw)


def _checks(spark, summary, ids=("ev_0001",), verdict="supported", columns=("revenue",), evidence=BASE):
    found = _audit(spark, [("H1", summary, verdict, list(ids), list(columns))], evidence).collect()
    return {r.check for r in found}


GOOD = "Treatment increased revenue by 17.5 across 120 customers, a significant and large effect (p = 0.004)"


def test_sound_claim_passes(spark):
    claims = spark.createDataFrame([("r", "H1", GOOD, "supported", ["ev_0001"], ["revenue"])], CLAIM_SCHEMA)
    found = audit.violations(claims, spark.createDataFrame(BASE, EVIDENCE_SCHEMA), SCHEMA_COLUMNS)
    assert found.collect() == []
    assert audit.claim_audit(claims, found).first().passed
    assert audit.audit_passed(found).first() == (True, 0, 0)


# Each claim trips exactly the named checks.
CASES = [
    ("Revenue was higher after the change", {"ids": ()}, {"provenance_grounding"}),
    ("Revenue was higher after the change", {"ids": ("ev_0001", "ev_9999")}, {"provenance_grounding"}),
    ("Revenue was higher by 55.5 units", {}, {"numerical_exactness"}),
    ("Revenue was higher after the change", {"columns": ("revenue", "ghost")}, {"schema_integrity"}),
    ("The new price caused higher revenue", {}, {"causal_language_guard"}),
    ("There is a significant rise", {"evidence": [_row("ev_0001", result={"p": 0.35})]}, {"significance_check"}),
    ("There is a significant rise", {"evidence": [_row("ev_0001", result={"p": 0.04, "q": 0.12})]}, {"fdr_check"}),
    ("There is a strong relationship here", {"evidence": [_row("ev_0001", result={"effect_size": 0.08})]}, {"effect_size_check"}),
    ("Revenue decreased after the change", {}, {"directionality_check"}),
    ("Measured with n = 5000 customers here", {}, {"sample_size_check", "numerical_exactness"}),
    ("The model explains churn well", {"ids": ("ev_0002",), "evidence": [_row("ev_0002", "model", {"feature_importance.churn": 0.98}, {"target": "churn"})]}, {"data_leakage_check"}),
    ("Revenue was higher across all segments", {"evidence": [_row("ev_0001", code="SELECT x FROM t where a = 1")]}, {"scope_check"}),
    ("Revenue was higher across all segments", {"evidence": [_row("ev_0001", params={"filter": "a"})]}, {"scope_check"}),
    ("Data exists in the table", {}, {"non_vacuous_check"}),
    ("fine", {"verdict": ""}, {"non_vacuous_check"}),
]


@pytest.mark.parametrize(("summary", "options", "expected"), CASES)
def test_each_check(spark, summary, options, expected):
    assert _checks(spark, summary, **options) == expected


def test_boundaries_of_p_and_q(spark):
    """p = alpha is not significant and q = threshold fails."""
    at = [_row("ev_0001", result={"p": 0.05, "q": 0.05})]
    assert _checks(spark, "There is a significant rise", evidence=at) == {"significance_check", "fdr_check"}
    zero = [_row("ev_0001", result={"p": 0.0, "q": 0.0})]
    assert _checks(spark, "There is a significant rise", evidence=zero) == set()


CONTROLLED = {"attenuation_ratio": 0.82, "vif_x": 1.2, "raw_effect": 0.3}


@pytest.mark.parametrize(
    ("row", "allowed"),
    [
        (_row("ev_0001", result=CONTROLLED, test_name="controlled_association"), True),
        (_row("ev_0001", result=CONTROLLED | {"vif_x": 5.0}, test_name="controlled_association"), False),
        (_row("ev_0001", result={"attenuation_ratio": 0.9}, test_name="controlled_association"), False),
        (_row("ev_0001", params={"is_rct": "true"}), True),
        (_row("ev_0001", code="difference_in_differences(df)"), True),
    ],
)
def test_causal_wording_needs_a_design(spark, row, allowed):
    assert ("causal_language_guard" in _checks(spark, "The price drove a better outcome", evidence=[row])) != allowed


@pytest.mark.parametrize(
    ("text", "numbers"),
    [
        ("From 1,200 to 20% of 3.5, see H12 and ev_0015.", ["1,200", "20%", "3.5"]),
        ("In 3rd place with -7.25", ["7.25"]),
        ("x2 and no number", []),
        ("100%, 5", ["100%", "5"]),
    ],
)
def test_number_extraction(spark, text, numbers):
    claims = spark.createDataFrame([("r", "c", text, "", [], [])], CLAIM_SCHEMA)
    assert [r.raw for r in audit.claim_numbers(claims).orderBy("pos").collect()] == numbers


@pytest.mark.parametrize("target", [0.003, 0.012, 0.2, 0.499, 0.5, 0.501, 0.65, 1.7, 15.5, -12.3, 980.0, 123456.78])
def test_number_tolerance_equals_brute_force(spark, target):
    """Bucketed matching finds exactly the numbers a full comparison finds."""
    scale = abs(target)
    numbers = {round(scale * f + d, 5) for f in (0.97, 0.979, 0.981, 1.0, 1.019, 1.021, 1.03, 0.01, 0.0102) for d in (0, 0.0099, 0.0101)}
    numbers = sorted(v for v in numbers if v > 0 and v not in (0.0, 1.0))
    texts = [f"{v:.5f}" for v in numbers] + [f"{v:.5f}%" for v in numbers]
    claims = [(str(i), f"value {t} seen", "", ["ev_0001"], []) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([("r", *c) for c in claims], CLAIM_SCHEMA)
    cited = audit.citations(frame, spark.createDataFrame([_row("ev_0001", result={"v": target})], EVIDENCE_SCHEMA))
    flagged = {int(r.claim_id) for r in audit.check_numbers(frame, cited).collect()}

    def unmatched(text):
        v = float(text.rstrip("%"))
        options = (v, v / 100 if text.endswith("%") else v * 100)
        return v not in (0.0, 1.0) and all(abs(c - scale) > max(0.02 * scale, 0.01) for c in options)

    assert flagged == {i for i, t in enumerate(texts) if unmatched(t)}


def test_nested_results_become_leaves(spark):
    text = json.dumps({"a": {"b": [1, 2.5, {"c": 3}]}, "flag": True, "s": "4", "n": None})
    df = spark.createDataFrame([(text,), (None,)], "j string").select(audit.numeric_leaves(F.col("j")).alias("m"))
    assert [r.m for r in df.collect()] == [{"a.b.0": 1.0, "a.b.1": 2.5, "a.b.2.c": 3.0}, {}]


def test_hot_evidence_and_unnamed_claims(spark):
    """One evidence row cited by every claim."""
    rows = [("r", None, f"Revenue increased by {17.5 if i % 3 else 77}", "supported", ["ev_0001"], [], i) for i in range(1, 201)]
    claims = audit.named_claims(spark.createDataFrame(rows, CLAIM_SCHEMA + ", position int"))
    found = audit.violations(claims, spark.createDataFrame(BASE, EVIDENCE_SCHEMA))
    assert sorted(r.claim_id for r in found.collect()) == sorted(f"claim_{i}" for i in range(3, 201, 3))
    summary = audit.claim_audit(claims, found)
    assert summary.count() == 200 and summary.where("passed").count() == 134
    assert audit.audit_passed(found).first().violations == 66


def test_flat_schema_takes_both_shapes():
    assert audit.flat_schema({"t": {"a": 1, "b": 2}, "c": "int"}) == ["a", "b", "c"]


def _rubric(spark, rows):
    return {r.evidence_id: r for r in scoring.evidence_rubric(spark.createDataFrame(rows, EVIDENCE_SCHEMA)).collect()}


def test_rubric_pass_and_fail(spark):
    rows = [
        _row("ok", result={"p": 0.001, "n": 100.0, "effect_size": 0.85}),
        _row("rows", "sql", {"num_rows": 25.0}),
        _row("bad", result={"p": 0.25, "n": 15.0, "vif_x": 8.5, "effect_size": 0.05}),
        _row("leak", "model", {"metrics.r2": -0.2, "feature_importance.x": 0.99}),
        _row("empty", "sql", {"num_rows": 0.0}),
        _row("unknown", "sql", {}),
        _row("failed", status="error"),
        _row("edge", result={"p": 0.05, "q": 0.05, "n": 50.0, "effect_size": 0.2}),
        _row("small", result={"n_a": 30.0, "effect_size": 0.1}),
        _row("weak", result={"n": 500.0, "effect_size": 0.1}),
    ]
    found = _rubric(spark, rows)
    assert {k: (r.rubric_status, r.score) for k, r in found.items()} == {
        "ok": ("pass", 1.0), "rows": ("pass", 1.0), "bad": ("warning", 0.7), "leak": ("warning", 0.7), "empty": ("warning", 0.7),
        "unknown": ("pass", 1.0), "failed": ("failed", 0.0), "edge": ("pass", 1.0), "small": ("warning", 0.7), "weak": ("pass", 1.0),
    }
    assert len(found["bad"].issues) == 4 and len(found["leak"].issues) == 2
    assert found["leak"].issues[1] == "feature_dominates: x 99.0%"
    assert found["weak"].issues == ["effect_tiny: 0.100"]
    assert found["small"].issues[0] == "rows_few: 30"


def test_rigor_of_a_run(spark):
    frame = spark.createDataFrame([_row("a"), _row("b", "sql", {"num_rows": 0.0}), _row("c", status="error")], EVIDENCE_SCHEMA)
    row = scoring.rigor_score(scoring.evidence_rubric(frame)).first()
    assert (row.overall_status, row.overall_score, row.total_evidences) == ("warning", 0.567, 3)


def test_ranking_is_stable_and_weighted(spark):
    rows = [
        ("r", 1, "c1", "weak", "high", ["x"]), ("r", 2, "c2", "supported", "high", ["ev_0001"]), ("r", 3, "c3", "refuted", "high", []),
        ("r", 4, "c4", "supported", "low", []), ("r", 5, "c5", "odd", "odd", []), ("r", 6, "c6", None, None, []),
        ("r", 7, "c7", "inconclusive", "high", []),
    ]
    claims = spark.createDataFrame(rows, "run_id string, position int, claim_id string, verdict string, confidence string, evidence_ids array<string>")
    ranked = scoring.ranked_findings(claims).orderBy("rank").collect()
    assert [r.claim_id for r in ranked] == ["c2", "c1", "c3", "c4", "c7", "c6", "c5"]
    evidence = spark.createDataFrame(BASE, EVIDENCE_SCHEMA)
    table = {r.claim_id: r.key_statistics for r in scoring.findings_table(claims, evidence).collect()}
    assert table["c2"] == "ev_0001: p 0.0040 | effect 0.900 | 120 rows | q 0.0090"
    assert table["c1"] == "-"


def test_numbers_of_a_claim_are_checked_in_one_pass(spark, monkeypatch):
    written = []
    monkeypatch.setattr(audit, "cut_lineage", lambda df: written.append(df.columns) or df)
    claims = spark.createDataFrame(
        [("r", "H1", "7 and 7 of 17.5, 1750% and 900", "", ["ev_0001", "ev_0002"], []), ("r", "H2", "12 of 90", "", ["ev_9999"], [])], CLAIM_SCHEMA
    )
    evidence = spark.createDataFrame([*BASE[:1], _row("ev_0002", result={"n": 900.0})], EVIDENCE_SCHEMA)
    found = audit.check_numbers(claims, audit.citations(claims, evidence))
    assert sorted((r.claim_id, r.detail) for r in found.collect()) == [("H1", "7"), ("H1", "7")]
    assert not written and found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_texts_of_claims_are_searched_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(audit, "cut_lineage", lambda df: written.append(df.columns) or df)
    _audit(spark, [("H1", GOOD, "supported", ["ev_0001"], ["revenue"])])
    assert "numbers" in written[0] and "summary" not in written[0]
