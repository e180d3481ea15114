import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from plumbline.operators import ledger, provenance, replay, sessions

SCHEMA = (
    "run_id string, seq bigint, kind string, result map<string,double>, depends_on array<string>, created_at timestamp_ntz, "
    "dataset_hash string"
)
NOW = dt.datetime(2024, 5, 1)


def _batch(spark, lengths, first=1, shift=0.0):
    rows = [
        (run, i, "sql", {"n": float(i) + shift, "p": 0.5}, [f"ev_{i - 1:04d}"] if i > first else [], NOW, "h")
        for run, n in lengths.items()
        for i in range(first, first + n)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def _sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _chain(hashes, block):
    """Chain states by hand: before every item, then the final one."""
    if len(hashes) <= block:
        starts = [ledger.GENESIS]
    else:
        digests = []
        for b in range(0, len(hashes), block):
            state = ledger.GENESIS
            for h in hashes[b : b + block]:
                state = _sha(state, h)
            digests.append(state)
        starts = [prev for prev, _ in _chain(digests, block)]
    links = []
    for b, start in enumerate(starts):
        state = start
        for h in hashes[b * block : (b + 1) * block]:
            links.append((state, _sha(state, h)))
            state = links[-1][1]
    return links


@pytest.mark.parametrize("block", [256, 4, 3])
def test_chain_equals_hand_made_links(spark, block):
    rows = ledger.ledger_append(_batch(spark, {"long": 30, "short": 2}), block=block).collect()
    for run in ("long", "short"):
        ordered = sorted((r for r in rows if r.run_id == run), key=lambda r: r.seq)
        assert [r.id for r in ordered[:2]] == ["ev_0001", "ev_0002"]
        assert [(r.prev_hash, r.hash) for r in ordered] == _chain([r.content_hash for r in ordered], block)
    if block == 256:
        ordered = sorted((r for r in rows if r.run_id == "long"), key=lambda r: r.seq)
        assert all(b.prev_hash == a.hash for a, b in zip(ordered, ordered[1:], strict=False))


@pytest.mark.parametrize("block", [256, 4])
def test_any_edit_breaks_the_chain(spark, block):
    stored = ledger.ledger_append(_batch(spark, {"a": 21, "b": 21}), block=block)
    assert [r.chain_valid for r in ledger.ledger_verify(stored, block=block).collect()] == [True, True]
    target = (F.col("run_id") == "a") & (F.col("seq") == 10)
    edits = {
        "result": F.create_map(F.lit("n"), F.lit(99.0)),
        "kind": F.lit("model"),
        "depends_on": F.array(F.lit("ev_0001")),
        "prev_hash": F.lit("0" * 64),
        "hash": F.lit("f" * 64),
    }
    for column, value in edits.items():
        edited = stored.withColumn(column, F.when(target, value).otherwise(F.col(column)))
        found = {r.run_id: r for r in ledger.ledger_verify(edited, block=block).collect()}
        assert (found["a"].chain_valid, found["a"].first_bad_seq, found["b"].chain_valid) == (False, 10, True), column


def test_runs_of_one_block_are_not_written_out(spark, monkeypatch):
    written = []
    monkeypatch.setattr(ledger, "cut_lineage", lambda df: written.append(df.columns) or df)
    stored = ledger.ledger_append(_batch(spark, {"a": 9}), block=16)
    assert ledger.ledger_verify(stored, block=16).first().chain_valid and not written


@pytest.mark.parametrize("block", [16, 4])
def test_columns_that_are_left_out_are_hashed(spark, block):
    rows = _batch(spark, {"a": 9, "b": 3})
    whole = ledger.ledger_append(rows, block=block)
    short = ledger.ledger_append(rows, block=block, columns=["id", "kind"])
    assert short.columns == ["run_id", "seq", "id", "kind", "content_hash", "prev_hash", "hash"]
    assert sorted(short.collect()) == sorted(whole.select(short.columns).collect())
    # runs of one block are linked without a join back to their rows
    assert ("Join" in short._jdf.queryExecution().optimizedPlan().toString()) == (block == 4)


def test_missing_rows_are_noticed(spark):
    stored = ledger.ledger_append(_batch(spark, {"a": 9}), block=4)
    assert not ledger.ledger_verify(stored.where("seq != 5"), block=4).first().chain_valid
    cut = stored.where("seq < 8")
    assert ledger.ledger_verify(cut, block=4).first().chain_valid  # the end is open without a header
    headers = spark.createDataFrame([("a", 9), ("gone", 3)], "run_id string, expected_count bigint")
    found = {r.run_id: r.chain_valid for r in ledger.ledger_verify(cut, headers, block=4).collect()}
    assert found == {"a": False, "gone": False}


def test_append_continues_a_run(spark):
    whole = ledger.ledger_append(_batch(spark, {"a": 11, "b": 3}), block=4)
    first = ledger.ledger_append(_batch(spark, {"a": 6, "b": 3}), block=4)
    later = _batch(spark, {"a": 5}, first=7).withColumn("seq", F.col("seq") - 6)
    later = later.withColumn("depends_on", F.array(F.concat(F.lit("ev_"), F.lpad((F.col("seq") + 5).cast("string"), 4, "0"))))
    appended = ledger.ledger_append(later, existing=first, block=4)
    assert sorted(r.seq for r in appended.collect()) == [7, 8, 9, 10, 11]
    both = first.unionByName(appended)
    assert sorted((r.run_id, r.seq, r.hash) for r in both.collect()) == sorted((r.run_id, r.seq, r.hash) for r in whole.collect())
    assert all(r.chain_valid for r in ledger.ledger_verify(both, block=4).collect())


def test_ids_keep_all_digits(spark):
    ids = spark.range(9999, 10001).select(ledger.evidence_id(F.col("id")).alias("e"))
    assert [r.e for r in ids.orderBy("e").collect()] == ["ev_10000", "ev_9999"]
    assert [r.n for r in ids.select(ledger.id_number(F.col("e")).alias("n")).orderBy("n").collect()] == [9999, 10000]


def test_json_hash_ignores_key_order(spark):
    df = spark.createDataFrame(
        [('{"a": 1, "b": {"x": [1, 2], "y": "z"}}', '{ "b":{"y":"z","x":[1,2]}, "a":1 }', '{"a": 1, "b": {"x": [2, 1], "y": "z"}}')],
        "x string, y string, z string",
    )
    a, b, c = df.select(*[ledger.canonical_json_hash(F.col(k)) for k in "xyz"]).first()
    assert a == b != c


def test_listing_totals_and_recent(spark):
    batch = _batch(spark, {"a": 12, "b": 2}).withColumns({"produced_by": F.lit("sql_agent"), "status": F.lit("ok")})
    stored = ledger.ledger_append(batch)
    assert [r.id for r in ledger.list_evidence(stored, "a").collect()][-1] == "ev_0012"
    assert ledger.get_evidence(stored, "b", "ev_0002").count() == 1
    assert ledger.ledger_totals(stored).collect() == [("sql", 14, 2)]
    assert ledger.ledger_totals(stored, run_id="b").collect() == [("sql", 2, 1)]
    assert ledger.ledger_totals(stored, kind="plot").count() == 0
    recent = ledger.ledger_recent(stored, 3).collect()
    assert [(r.run_id, r.id) for r in recent] == [("a", "ev_0012"), ("a", "ev_0011"), ("a", "ev_0010")]
    summary = {r.run_id: r for r in ledger.run_summary(stored).collect()}
    assert summary["a"].dataset_hash == "h" and summary["a"].evidence_count == 12


def test_exportable_rows(spark):
    rows = [("r", "ev_0001", True, "x = 1"), ("r", "ev_0002", True, "synthesis"), ("r", "ev_0003", False, "y"), ("r", "ev_0004", True, None)]
    df = spark.createDataFrame(rows, "run_id string, id string, exportable boolean, code string")
    assert [r.id for r in ledger.exportable(df).collect()] == ["ev_0001"]


def _graph(spark, edges):
    rows = [("r", node, deps, [f"col_{node}"] if own else []) for node, deps, own in edges]
    return spark.createDataFrame(rows, "run_id string, id string, depends_on array<string>, columns array<string>")


DIAMOND = [
    ("ev_0001", [], True), ("ev_0002", ["ev_0001"], True), ("ev_0003", ["ev_0001"], False),
    ("ev_0004", ["ev_0002", "ev_0003"], False), ("ev_0005", ["ev_0001", "ev_0004"], True), ("ev_0006", [], True),
]


def test_ancestors_descendants_and_columns(spark):
    graph = _graph(spark, DIAMOND)
    one = spark.createDataFrame([("r", "ev_0004"), ("r", "ev_0001")], "run_id string, id string")
    up, down = {}, {}
    for found, out in ((provenance.ancestors(graph, one), up), (provenance.descendants(graph, one), down)):
        for r in found.collect():
            out.setdefault(r.root[-1], set()).add(r.node[-1])
    assert up == {"4": {"1", "2", "3"}}
    assert down == {"4": {"5"}, "1": {"2", "3", "4", "5"}}
    columns = {}
    for r in provenance.trace_to_columns(graph).collect():
        columns.setdefault(r.id, set()).add(r.column)
    assert columns["ev_0004"] == {"col_ev_0001", "col_ev_0002"}
    assert columns["ev_0005"] == {"col_ev_0001", "col_ev_0002", "col_ev_0005"}
    assert sorted(r.id for r in provenance.sinks(graph).collect()) == ["ev_0005", "ev_0006"]


def test_levels_are_longest_distances(spark):
    found = {r.id[-1]: r.level for r in provenance.levels(_graph(spark, DIAMOND)).collect()}
    assert found == {"1": 0, "2": 1, "3": 1, "4": 2, "5": 3, "6": 0}
    with pytest.raises(ValueError, match="later"):
        provenance.levels(_graph(spark, [("ev_0001", ["ev_0002"], True), ("ev_0002", ["ev_0001"], True)]))


def test_long_chain_and_hot_node(spark):
    """A chain of 40 and a node cited by everything after it."""
    edges = [("ev_0001", [], True)] + [(f"ev_{i:04d}", sorted({"ev_0001", f"ev_{i - 1:04d}"}), False) for i in range(2, 41)]
    graph = _graph(spark, edges)
    last = spark.createDataFrame([("r", "ev_0040")], "run_id string, id string")
    assert provenance.ancestors(graph, last).count() == 39
    assert provenance.trace_to_columns(graph).count() == 40


def test_unknown_parent_stays_bare(spark):
    graph = spark.createDataFrame([("r", "ev_0001", ["ev_9999"], "sql", "x")], "run_id string, id string, depends_on array<string>, kind string, produced_by string")
    assert provenance.parents(graph).collect() == [("r", "ev_0001", "ev_9999", None, None)]
    roots = graph.select("run_id", "id")
    assert [r.node for r in provenance.ancestors(graph, roots).collect()] == ["ev_9999"]


def test_replay_reasons(spark):
    inf, nan = float("inf"), float("nan")
    expected = {"same": 1.0, "close": 2.0, "inf": inf, "nan": nan, "off": 3.0, "gone": 4.0, "sign": inf, "zero": 0.0, "null": None}
    actual = {"same": 1.0, "close": 2.0000000001, "inf": inf, "nan": nan, "off": 3.1, "extra": 5.0, "sign": -inf, "zero": 1e-12, "null": 0.0}
    schema = "run_id string, id string, result map<string,double>"
    left = spark.createDataFrame([("r", "e1", expected), ("r", "e2", {"a": 1.0})], schema)
    right = spark.createDataFrame([("r", "e1", actual), ("r", "e3", {"b": 1.0})], schema)
    found = {(r.id, r.key): r.reason for r in replay.replay_diff(left, right).collect()}
    assert found == {
        ("e1", "off"): "mismatch", ("e1", "gone"): "missing_in_actual", ("e1", "extra"): "missing_in_expected",
        ("e1", "sign"): "mismatch", ("e1", "zero"): "mismatch", ("e1", "null"): "mismatch",
        ("e2", "a"): "missing_in_actual", ("e3", "b"): "missing_in_expected",
    }


EVIDENCE = [
    ("r", "ev_0001", "ok", {"pct_change": -12.3456, "n": 1234567.0, "m.r2": 0.125, "tie": 2.675}, {"alpha": "0.05", "name": "x"}),
    ("r", "ev_0002", "error", {"v": 1.0}, {}),
]
TEMPLATES = {
    "Fell {ev_0001.result.pct_change:.1f}% over {ev_0001.result.n:,.0f} rows.": "Fell -12.3% over 1,234,567 rows.",
    "{ev_0001.result.m.r2:.1%} and {ev_0001.result.tie:.2f}": "12.5% and 2.67",
    "at {ev_0001.params.alpha} {ev_0001.params.alpha:.2f} for {ev_0001.params.name:s}, n={ev_0001.result.n}": "at 0.05 0.05 for x, n=1234567",
    "no placeholder {here}": "no placeholder {here}",
    "$1 {ev_0001.result.n:s}\\": "$1 1234567\\",
}
BAD = {
    "{ev_0001.result.missing}": "unknown_path",
    "{ev_0001.result.n:.9f}": "bad_format",
    "{ev_0002.result.v}": "failed_evidence",
    "{ev_0009.result.v}": "unknown_id",
    "{ev_0001.columns.n}": "bad_path_root",
    "{ev_0001.params.name:.1f}": "not_a_number",
    "{ev_0001.result.n} then {ev_0009.result.v} then {ev_0002.result.v}": "unknown_id",
}


def test_templates(spark):
    evidence = spark.createDataFrame(EVIDENCE, "run_id string, id string, status string, result map<string,double>, params map<string,string>")
    texts = [*TEMPLATES, *BAD]
    frame = spark.createDataFrame([("r", i, t) for i, t in enumerate(texts)], "run_id string, template_id int, text string")
    found = {texts[r.template_id]: r for r in replay.resolve_templates(frame, evidence).collect()}
    assert {t: found[t].resolved for t in TEMPLATES} == TEMPLATES
    assert {t: found[t].error for t in BAD} == BAD
    assert all(found[t].resolved is None and found[t].status == "unresolved" for t in BAD)


def test_sessions(spark):
    turns = spark.createDataFrame(
        [("s", 1, ["e1", "e2"]), ("s", 2, ["e2", "e3"]), ("s", 3, ["e1"]), ("t", 1, [])],
        "session_id string, turn int, evidence_ids array<string>",
    )
    counts = {(r.session_id, r.turn): (r.new_ids, r.total_ids) for r in sessions.session_evidence(turns).collect()}
    assert counts == {("s", 1): (2, 2), ("s", 2): (1, 3), ("s", 3): (0, 3), ("t", 1): (0, 0)}
    talk = spark.createDataFrame(
        [("s", 1, "why?", "x" * 150), ("s", 2, "and?", None)], "session_id string, turn int, question string, finding string"
    )
    lines = sessions.context_lines(talk)
    prompt = sessions.follow_up_question(lines, "s", 2, "and?")
    assert prompt == f"Known so far\nasked why? | found {'x' * 150}\nNow asked\nand?"
    assert sessions.follow_up_question(lines, "s", 1, "why?") == "why?"
