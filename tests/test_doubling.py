"""Closures by doubling, and the audit from one pass."""

import random

from pyspark.sql import functions as F

from plumbline.operators import audit, provenance
from plumbline.plans import cases

SCHEMA = "run_id string, id string, depends_on array<string>, columns array<string>"


def graph(spark, edges, n, run="r"):
    return [(run, f"ev_{i:04d}", [f"ev_{p:04d}" for p in edges.get(i, ())], [f"c{i}"] if i % 50 == 1 else []) for i in range(1, n + 1)]


def test_a_chain_of_a_thousand_takes_few_rounds(spark):
    rows = graph(spark, {i: [i - 1] for i in range(2, 1_001)}, 1_000)
    evidence = spark.createDataFrame(rows, SCHEMA)
    links = provenance.edges(evidence).select("run_id", F.col("parent").alias("node"), F.col("child").alias("next"))
    assert len(list(provenance._jumps(links))) <= 12
    assert provenance.ancestors(evidence, evidence.where("id = 'ev_1000'").select("run_id", "id")).count() == 999
    assert {(r.id, r.level) for r in provenance.levels(evidence).collect()} == {(f"ev_{i:04d}", i - 1) for i in range(1, 1_001)}


def test_closures_of_random_graphs(spark):
    rng = random.Random(9)
    rows, expected, depth, columns = [], set(), {}, set()
    for run in ("p", "q", "s"):
        n = 60
        edges = {i: sorted(rng.sample(range(1, i), min(i - 1, rng.randrange(4)))) for i in range(2, n + 1)}
        rows += graph(spark, edges, n, run)
        above = {}
        for i in range(1, n + 1):
            above[i] = set().union(*[{p} | above[p] for p in edges.get(i, ())], set())
            depth[run, i] = max([depth[run, p] + 1 for p in edges.get(i, ())], default=0)
            expected |= {(run, i, a) for a in above[i]}
            columns |= {(run, i, f"c{a}") for a in above[i] | {i} if a % 50 == 1}
    evidence = spark.createDataFrame(rows, SCHEMA)
    number = F.substring("id", 4, 9).cast("int")
    everyone = evidence.select("run_id", "id")
    up = {(r.run_id, int(r.root[3:]), int(r.node[3:])) for r in provenance.ancestors(evidence, everyone).collect()}
    down = {(r.run_id, int(r.node[3:]), int(r.root[3:])) for r in provenance.descendants(evidence, everyone).collect()}
    assert up == down == expected
    assert {(r.run_id, r.n): r.level for r in provenance.levels(evidence).select("run_id", number.alias("n"), "level").collect()} == depth
    assert {(r.run_id, int(r.id[3:]), r["column"]) for r in provenance.trace_to_columns(evidence).collect()} == columns


def test_circles_end(spark):
    rows = [("r", "ev_0001", ["ev_0003"], []), ("r", "ev_0002", ["ev_0001"], []), ("r", "ev_0003", ["ev_0002"], []), ("r", "ev_0004", ["ev_0004"], [])]
    evidence = spark.createDataFrame(rows, SCHEMA)
    found = provenance.ancestors(evidence, evidence.select("run_id", "id")).collect()
    assert {(r.root, r.node) for r in found} == {(f"ev_000{a}", f"ev_000{b}") for a in (1, 2, 3) for b in (1, 2, 3) if a != b}


def _rows(frame):
    return sorted((r.run_id, r.claim_id, r.check, r.detail or "", r.severity) for r in frame.collect())


def test_one_pass_finds_what_the_single_checks_find(spark):
    sf_dir = "/root/testdata/sf0.001"
    claims, evidence = cases.claims(spark, sf_dir), cases.evidence(spark, sf_dir)
    cited = audit.citations(claims, evidence)
    single = [
        audit.check_provenance(claims, cited), audit.check_numbers(claims, cited), audit.check_columns(claims, cases.SCHEMA_COLUMNS), audit.check_causal(claims, cited),
        audit.check_significance(claims, cited), audit.check_fdr(cited), audit.check_effect(claims, cited), audit.check_direction(cited),
        audit.check_sample_size(claims, cited), audit.check_leakage(cited), audit.check_scope(cited), audit.check_vacuous(claims),
    ]
    expected = sorted(row for frame in single for row in _rows(frame))
    assert len(expected) > 500 and len({row[2] for row in expected}) == 12
    assert _rows(audit.violations(claims, evidence, cases.SCHEMA_COLUMNS)) == expected


def test_citations_are_scanned_once(spark):
    evidence = spark.createDataFrame([("r", f"ev_{i:04d}", "stat_test", "t", "", {}, {"p": 0.2, "n": float(i)}) for i in range(3_000)], "run_id string, id string, kind string, test_name string, code string, params map<string,string>, result map<string,double>")
    ids = [f"ev_{i:04d}" for i in range(3_100)]
    claims = spark.createDataFrame([("r", "hot", "a significant rise of 2999 and 5555555", "", ids, []), ("r", "bare", "", None, None, None)], "run_id string, claim_id string, summary string, verdict string, evidence_ids array<string>, columns array<string>")
    found = _rows(audit.violations(claims, evidence))
    assert [r for r in found if r[1] == "bare"] == [("r", "bare", "non_vacuous_check", "0 words", "critical"), ("r", "bare", "provenance_grounding", "", "critical")]
    hot = [r[2:4] for r in found if r[1] == "hot"]
    assert hot.count(("significance_check", "")) == 1 and ("numerical_exactness", "5555555") in hot and ("numerical_exactness", "2999") not in hot
    assert sum(check == "provenance_grounding" for check, _ in hot) == 100


def test_runs_meet_in_one_row_or_take_the_rounds(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for run, n in (("short", 5), ("long", 20), (None, 3)):
        rows += graph(spark, {i: sorted(rng.sample(range(1, i), min(i - 1, 3))) for i in range(2, n + 1)}, n, run)
    rows += [("odd", "ev_0001", None, None), ("odd", "ev_0002", ["ev_0001", None, "ev_0000"], ["c", None]), ("odd", "ev_0003", ["ev_0002"], [])]
    evidence = spark.createDataFrame(rows, SCHEMA)

    def every():
        up = provenance.ancestors(evidence, provenance.sinks(evidence))
        down = provenance.descendants(evidence, provenance.sources(evidence))
        frames = (up, down, provenance.trace_to_columns(evidence), provenance.levels(evidence), provenance.sinks(evidence))
        return [sorted(map(str, f.collect())) for f in frames]

    def no_rounds(*_):
        raise AssertionError("short runs take no rounds")

    found = []
    for bound in (0, 40):  # by rounds alone, and only the long run by rounds
        monkeypatch.setattr(provenance, "SHORT", bound)
        found.append(every())
    monkeypatch.setattr(provenance, "SHORT", 4096)
    monkeypatch.setattr(provenance, "_jumps", no_rounds)
    found.append(every())
    assert found[0] == found[1] == found[2]
