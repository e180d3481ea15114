"""Nested results: leaves, paths, differences and templates."""

import json
import math
import random

from pyspark.sql import functions as F

from plumbline.operators import audit, nested, replay

SCHEMA = "run_id string, id string, result string"


def walk(value, path=""):
    if isinstance(value, dict) and value:
        return [leaf for k, v in value.items() for leaf in walk(v, f"{path}.{k}" if path else k)]
    if isinstance(value, list) and value:
        return [leaf for i, v in enumerate(value) for leaf in walk(v, f"{path}.{i}" if path else str(i))]
    return [(path, value)]


def draw(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 5)
    if kind == 5:
        return {f"k{i}": draw(rng, depth + 1) for i in range(rng.randrange(4))}
    if kind == 6:
        return [draw(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, False, rng.randrange(100), rng.random(), "t", "", 1e300, -5])


def test_leaves_are_those_of_a_walk(spark):
    rng = random.Random(4)
    documents = [json.dumps(draw(rng)) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(documents)), "i int, j string")
    rows = frame.select("i", F.explode(nested.leaves(F.try_parse_json("j"))).alias("e")).select("i", "e.path", F.to_json("e.value").alias("t")).collect()
    found = {}
    for r in rows:
        found.setdefault(r.i, []).append((r.path, json.loads(r.t)))
    for i, text in enumerate(documents):
        expected = sorted(walk(json.loads(text)), key=lambda x: x[0])
        assert sorted(found[i], key=lambda x: x[0]) == expected, text
    maps = [r.m for r in frame.select(audit.numeric_leaves(F.col("j")).alias("m")).collect()]
    for text, m in zip(documents, maps, strict=True):
        assert m == {p: float(v) for p, v in walk(json.loads(text)) if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)}


def test_text_that_is_no_json_does_not_stop_the_job(spark):
    frame = spark.createDataFrame([(1, "{bad"), (2, ""), (3, None), (4, '{"a.b":1,"a":{"b":2}}'), (5, "7")], "i int, j string")
    found = {r.i: r.m for r in frame.select("i", audit.numeric_leaves(F.col("j")).alias("m")).collect()}
    assert found == {1: None, 2: {}, 3: {}, 4: {"a.b": found[4]["a.b"]}, 5: {"": 7.0}}


def test_what_is_nested_too_deep_stays_one_leaf(spark):
    frame = spark.createDataFrame([('{"a":{"b":{"c":1}}}',)], "j string")
    assert [r.path for r in frame.select(F.inline(nested.leaves(F.try_parse_json("j"), 2))).collect()] == ["a.b"]


def test_differences_by_path(spark):
    left = [
        ("r", "same", '{"a":[1,{"b":"x"}],"z":null}'), ("r", "edit", '{"a":[1,{"b":"x"}]}'), ("r", "type", '{"a":1,"b":"1"}'),
        ("r", "bad", '{"a":'), ("r", "gone", '{"a":1}'), ("r", "deep", '{"a":{"b":1}}'), ("r", "empty", "{}"), ("r", "none", None),
    ]
    right = [
        ("r", "same", '{"z":null,"a":[1.0,{"b":"x"}]}'), ("r", "edit", '{"a":[1,{"b":"y"},3]}'), ("r", "type", '{"a":"1","b":"1"}'),
        ("r", "bad", '{"a":1}'), ("r", "deep", '{"a":5}'), ("r", "empty", "{}"), ("r", "none", None),
    ]
    rows = replay.nested_diff(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)).collect()
    assert {(r.id, r.key, r.expected, r.actual, r.reason) for r in rows} == {
        ("edit", "a.1.b", '"x"', '"y"', "mismatch"), ("edit", "a.2", None, "3", "missing_in_expected"), ("type", "a", "1", '"1"', "mismatch"),
        ("bad", None, None, None, "malformed_expected"), ("gone", "a", "1", None, "missing_in_actual"),
        ("deep", "a.b", "1", None, "missing_in_actual"), ("deep", "a", None, "5", "missing_in_expected"),
    }


def test_templates_over_nested_results(spark):
    result = '{"change":{"pct":-12.3456,"by":["a",2]},"n":100,"note":"hello","flag":true,"none":null,"long":12345678901234567}'
    evidence = spark.createDataFrame(
        [("r", "ev_0001", "ok", result, '{"alpha":0.05}'), ("r", "ev_0002", "ok", "{", "{}"), ("r", "ev_0003", "error", "{}", "{}")],
        "run_id string, id string, status string, result string, params string",
    )
    good = {
        "Change was {ev_0001.result.change.pct:.1f}%": "Change was -12.3%",
        "N = {ev_0001.result.n}": "N = 100",
        "String is {ev_0001.result.note:s}": "String is hello",
        "{ev_0001.result.change.by} {ev_0001.result.flag} {ev_0001.result.none} {ev_0001.result.long}": '["a",2] True None 12345678901234567',
        "{ev_0001.params.alpha} {ev_0001.params.alpha:.1%}": "0.05 5.0%",
    }
    bad = {
        "{ev_0001.result.missing}": "unknown_path", "{ev_0001.result.change.by.0}": "unknown_path", "{ev_0001.status}": "bad_path_root",
        "{ev_0001.result.note:.2f}": "not_a_number", "{ev_0001.result.n:.__class__}": "bad_format", "{ev_0002.result.n}": "malformed_json",
        "{ev_0003.result.val}": "failed_evidence", "{ev_0009.result.val}": "unknown_id",
    }
    texts = [*good, *bad]
    frame = spark.createDataFrame([("r", i, t) for i, t in enumerate(texts)], "run_id string, template_id int, text string")
    found = {texts[r.template_id]: r for r in replay.resolve_templates(frame, evidence).collect()}
    assert {t: found[t].resolved for t in good} == good
    assert {t: found[t].error for t in bad} == bad
