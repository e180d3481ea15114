import datetime as dt

import numpy as np

from plumbline.operators import ledger, provenance
from plumbline.operators.dispatch import Hypothesis
from plumbline.operators.review import conclude, review

NOW = dt.datetime(2024, 5, 1)
CLAIMS = "run_id string, position int, claim_id string, summary string, verdict string, confidence string, evidence_ids array<string>, columns array<string>"


def test_review_end_to_end(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b), float(c)) for a, b, c in zip(rng.normal(11, 1, 60), rng.normal(21, 1, 60), rng.normal(0, 1, 60), strict=True)]
    df = spark.createDataFrame(rows, "rev_before double, rev_after double, noise double")
    questions = [
        Hypothesis("H1", "before_after", "rev_before", "rev_after"),
        Hypothesis("H2", "association", "rev_before", "noise"),
        Hypothesis("H3", "unknown", "noise"),
    ]
    done = review(df, questions, "run_1", "d" * 64, NOW)
    evidence = {r.id: r for r in done.evidence.collect()}
    assert [evidence[i].status for i in ("ev_0001", "ev_0002", "ev_0003")] == ["ok", "ok", "error"]
    assert evidence["ev_0001"].result["q"] < 0.001 and evidence["ev_0002"].result["q"] >= evidence["ev_0002"].result["pearson_p"]
    assert ledger.ledger_verify(done.evidence).first().chain_valid
    assert done.rigor.first().total_evidences == 3
    assert provenance.ancestors(done.evidence, done.evidence.where("id = 'ev_0003'")).count() == 2
    mean = evidence["ev_0001"].result["mean_b"]
    claims = spark.createDataFrame(
        [
            ("run_1", 1, "H1", f"Revenue rose to {mean:.2f}, a significant and large effect", "supported", "high", ["ev_0001"], ["rev_after"]),
            ("run_1", 2, "H2", "Revenue fell to 3.14, which proves the point", "supported", "high", ["ev_0001"], ["ghost"]),
        ],
        CLAIMS,
    )
    end = conclude(claims, done.evidence, df.columns)
    assert {r.claim_id: r.passed for r in end.audit.collect()} == {"H1": True, "H2": False}
    assert {r.check for r in end.violations.collect()} == {
        "numerical_exactness", "schema_integrity", "causal_language_guard", "directionality_check",
    }
    assert [r.claim_id for r in end.findings.orderBy("rank").collect()] == ["H1", "H2"]


def test_evidence_of_any_tool(spark):
    from pyspark.sql import functions as F

    from plumbline.operators import audit
    from plumbline.operators.review import Outcome, tool_evidence, with_flat_results

    segments = spark.createDataFrame([("region", "EU", 2.5, 1), ("region", None, 4.0, 2)], "segment string, label string, value double, rank int")
    total = spark.createDataFrame([(7.0, "seven")], "delta double, said string")
    nothing = segments.limit(0)
    outcomes = [
        Outcome("analysis", "explore", "top_segments", segments, ("segment", "label"), ("value", "rank"), ("revenue",), {"top": 5}),
        Outcome("analysis", "explore", "decomposition", total, (), ("delta", "said")),
        Outcome("validation", "quality", "none", nothing, ("label",), ("value",)),
    ]
    chained = ledger.ledger_append(tool_evidence(spark, outcomes, "run_1", "d" * 64, NOW, start=1))
    assert ledger.ledger_verify(chained).first().chain_valid
    rows = {r.id: r for r in chained.collect()}
    assert rows["ev_0002"].result == '{"all":{"delta":7.0,"said":"seven"}}' and rows["ev_0003"].result == "{}"
    assert (rows["ev_0001"].params, rows["ev_0001"].columns, rows["ev_0001"].depends_on, rows["ev_0002"].depends_on) == ({"top": "5"}, ["revenue"], [], ["ev_0001"])
    flat = {r.id: r.result for r in with_flat_results(chained).collect()}
    assert flat["ev_0001"] == {"region/-.rank": 2.0, "region/-.value": 4.0, "region/EU.rank": 1.0, "region/EU.value": 2.5} and flat["ev_0002"] == {"all.delta": 7.0}
    claims = spark.createDataFrame([("run_1", "H1", "EU earned 2.5 and the change was 9999", "supported", ["ev_0001", "ev_0002"], [])], "run_id string, claim_id string, summary string, verdict string, evidence_ids array<string>, columns array<string>")
    found = audit.violations(claims, with_flat_results(chained)).select("check", "detail").where(F.col("check") == "numerical_exactness").collect()
    assert [r.detail for r in found] == ["9999"]


def test_prompts_of_asked_turns(spark):
    from plumbline.operators import sessions

    talk = spark.createDataFrame([("s", 1, "why?", "a"), ("s", 2, "and?", None), ("s", 3, "so?", "c"), ("t", 1, "hm?", "b")], "session_id string, turn int, question string, finding string")
    lines = sessions.context_lines(talk)
    asked = talk.where("turn in (1, 3)").select("session_id", "turn", "question")
    found = {(r.session_id, r.turn): r.prompt for r in sessions.turn_prompts(lines, asked).collect()}
    assert found == {("s", 1): "why?", ("t", 1): "hm?", ("s", 3): "Known so far\nasked why? | found a\nasked and? | found \nNow asked\nso?"}
    assert found["s", 3] == sessions.follow_up_question(lines, "s", 3, "so?")
