"""Provenance over the ``depends_on`` edges of evidence.

Closures double their steps: a round joins the jumps of 2^k edges with
themselves to jumps of 2^(k+1), and every distance is a sum of such powers, so a
lineage of depth d takes about log2(d) rounds.  Only jumps of exactly 2^k edges
are kept, never all pairs; a chain has at most as many of them as edges.
Every round is written out.

Most runs are short.  Those of up to ``SHORT`` rows, edges and marks meet in one
row and are walked there; only longer ones take the rounds.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ledger import id_number
from plumbline.session import cut_lineage

#: Rows, edges and marks of a run that may meet in one row.
SHORT = 4096
_RUNS_AT_ONCE = 64


def edges(evidence: DataFrame) -> DataFrame:
    """``run_id, parent, child`` for every dependency; ids are unique in a run."""
    return evidence.select(
        "run_id", F.explode(F.array_distinct("depends_on")).alias("parent"), F.col("id").alias("child")
    )


def _jumps(links: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """(2^k, pairs ``node``, ``next`` that a path of exactly 2^k links joins) while there are any.

    No path without a cycle is longer than the links of its run, which ends the
    rounds where links go in circles.
    """
    jumps = cut_lineage(links.select("run_id", "node", "next").distinct())
    longest = jumps.groupBy("run_id").count().agg(F.max("count").alias("m")).first()["m"] or 0
    span = 1
    while span <= longest and not jumps.isEmpty():
        yield span, jumps
        onward = jumps.select("run_id", F.col("node").alias("next"), F.col("next").alias("far"))
        jumps = cut_lineage(jumps.join(onward, ["run_id", "next"]).select("run_id", "node", F.col("far").alias("next")).distinct())
        span *= 2


def _grow(start: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows reachable from ``start``; links map ``node`` to ``next``."""
    reached = cut_lineage(start.distinct())
    for _, jumps in _jumps(links):
        further = reached.join(jumps, ["run_id", "node"]).select("run_id", *keys, F.col("next").alias("node"))
        reached = cut_lineage(reached.select("run_id", *keys, "node").unionByName(further).distinct())
    return reached


def _near():
    return F.array_distinct(F.coalesce("depends_on", F.array().cast("array<string>"))).alias("near")


def _by_length(items: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows (run_id, near, marks, ...) of short runs and, if there are any, of long ones."""
    weight = F.lit(1) + F.size("near") + F.size("marks")
    long = cut_lineage(items.groupBy("run_id").agg(F.sum(weight).alias("n")).where(F.col("n") > SHORT).select("run_id"))
    if long.isEmpty():
        return items, None
    return items.join(long, "run_id", "left_anti"), items.join(long, "run_id", "left_semi")


def _walk(short: DataFrame, rows_of: Callable, schema: str) -> DataFrame:
    """``run_id`` and the pairs ``rows_of`` finds in the ids, edges and marks of each short run."""
    held = F.collect_list(F.struct("id", "near", "marks")).alias("rows")
    grouped = short.groupBy("run_id").agg(held).select("run_id", "rows.id", "rows.near", "rows.marks")

    def walked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _RUNS_AT_ONCE):
                part = batch.slice(start, _RUNS_AT_ONCE)
                places, first, second = [], [], []
                for place, (run, *run_rows) in enumerate(zip(*[c.to_pylist() for c in part.columns], strict=True)):
                    for a, b in rows_of(run is not None, *run_rows):
                        places.append(place)
                        first.append(a)
                        second.append(b)
                whole = [part.column(0).take(pa.array(places, pa.int64())), pa.array(first, pa.string())]
                kind = pa.int32() if schema.endswith("int") else pa.string()
                yield pa.RecordBatch.from_arrays([*whole, pa.array(second, kind)], names=["run_id", "a", "b"])

    run_type = short.schema["run_id"].dataType.simpleString()
    return grouped.mapInArrow(walked, f"run_id {run_type}, {schema}")


def _reached(up: bool) -> Callable:
    """Pairs (node, mark) of one run: marks wander to parents or, without ``up``, to children."""

    def rows_of(linked: bool, ids: list, near: list, marks: list) -> Iterator[tuple[str, str]]:
        onward, held, bits = {}, {}, {}
        for own, others, own_marks in zip(ids, near, marks, strict=True):
            for other in others if linked else ():
                if other is not None:
                    node, following = (own, other) if up else (other, own)
                    onward.setdefault(node, []).append(following)
            for mark in own_marks:
                held[own] = held.get(own, 0) | 1 << bits.setdefault(mark, len(bits))
        waiting = deque(held)
        queued = set(waiting)
        while waiting:
            node = waiting.popleft()
            queued.discard(node)
            for following in onward.get(node, ()) if node is not None else ():
                before = held.get(following, 0)
                if before | held[node] != before:
                    held[following] = before | held[node]
                    if following not in queued:
                        queued.add(following)
                        waiting.append(following)
        names = list(bits)
        for node, mask in held.items():
            while mask:
                lowest = mask & -mask
                yield node, names[lowest.bit_length() - 1]
                mask ^= lowest

    return rows_of


def _spread(items: DataFrame, up: bool) -> DataFrame:
    """Distinct ``run_id, node, mark``: where the marks of rows (run_id, id, near, marks) get along their edges."""
    short, long = _by_length(items)
    found = _walk(short, _reached(up), "node string, mark string")
    if long is None:
        return found
    source, target = ("id", "_near") if up else ("_near", "id")
    links = long.select("run_id", "id", F.explode("near").alias("_near")).select("run_id", F.col(source).alias("node"), F.col(target).alias("next"))
    start = long.select("run_id", F.explode("marks").alias("mark"), F.col("id").alias("node"))
    return found.unionByName(_grow(start, links, ["mark"]).select("run_id", "node", "mark"))


def ancestors(evidence: DataFrame, roots: DataFrame) -> DataFrame:
    """Everything each root (run_id, id) was derived from: ``run_id, root, node``."""
    return _from_roots(evidence, roots, True)


def descendants(evidence: DataFrame, roots: DataFrame) -> DataFrame:
    """Everything derived from each root (run_id, id): ``run_id, root, node``."""
    return _from_roots(evidence, roots, False)


def _from_roots(evidence: DataFrame, roots: DataFrame, up: bool) -> DataFrame:
    none = F.array().cast("array<string>")
    items = evidence.select("run_id", "id", _near(), none.alias("marks"))
    items = items.unionByName(roots.select("run_id", "id", none.alias("near"), F.array("id").alias("marks")))
    return _spread(items, up).select("run_id", F.col("mark").alias("root"), "node").where("node != root")


def sinks(evidence: DataFrame) -> DataFrame:
    """Final results: evidence no other evidence depends on."""
    items = evidence.select("run_id", "id", _near(), F.array().cast("array<string>").alias("marks"))
    short, long = _by_length(items)
    cited = F.filter(F.flatten(F.collect_list("near")), lambda c: c.isNotNull())
    ids = F.collect_list(F.struct("id")).alias("rows")
    grouped = short.groupBy("run_id").agg(ids, F.array_distinct(cited).alias("cited")).select("run_id", F.col("rows.id").alias("ids"), "cited")
    left = F.when(F.col("run_id").isNull(), F.col("ids")).otherwise(F.array_except("ids", "cited"))
    found = grouped.select("run_id", F.explode(left).alias("id"))
    if long is None:
        return found
    parents_of_any = long.select("run_id", F.explode("near").alias("id")).distinct()
    return found.unionByName(long.select("run_id", "id").join(parents_of_any, ["run_id", "id"], "left_anti"))


def sources(evidence: DataFrame) -> DataFrame:
    """Evidence that depends on nothing."""
    return evidence.where(F.size(F.coalesce("depends_on", F.array())) == 0).select("run_id", "id")


def trace_to_columns(evidence: DataFrame) -> DataFrame:
    """Dataset columns behind every evidence row: ``run_id, id, column``.

    Columns travel down the edges, so the result is bounded by rows times
    columns of the dataset and no ancestor pairs are made.
    """
    columns = F.coalesce("columns", F.array().cast("array<string>")).alias("marks")
    return _spread(evidence.select("run_id", "id", _near(), columns), False).select("run_id", F.col("node").alias("id"), F.col("mark").alias("column"))


def parents(evidence: DataFrame) -> DataFrame:
    """Direct parents with kind and producer; unknown ids are kept bare."""
    known = evidence.select("run_id", F.col("id").alias("parent"), "kind", "produced_by")
    return edges(evidence).join(known, ["run_id", "parent"], "left").select(
        "run_id", F.col("child").alias("id"), "parent", "kind", "produced_by"
    )


def order_breaks(evidence: DataFrame) -> DataFrame:
    """Edges whose parent does not come before its child."""
    later = F.exists("depends_on", lambda p: id_number(p) >= id_number(F.col("id")))
    return edges(evidence.where(later)).where(id_number(F.col("parent")) >= id_number(F.col("child")))


def levels(evidence: DataFrame) -> DataFrame:
    """Replay order: every row's longest distance from a row without parents.

    Ids are numbered as they are recorded, so edges point from lower to higher
    numbers and the walk ends; an edge that does not is an error.
    """
    if not order_breaks(evidence).isEmpty():
        raise ValueError("evidence depends on later evidence")
    short, long = _by_length(evidence.select("run_id", "id", "depends_on", _near(), F.array().alias("marks")))
    found = _walk(short, _depths, "id string, level int")
    return found if long is None else found.unionByName(_long_levels(long))


def _depths(linked: bool, ids: list, near: list, marks: list) -> Iterable[tuple[str, int]]:
    """Pairs (id, level) of one run."""
    depth = dict.fromkeys(ids, 0)
    inner = {}
    for own, others in zip(ids, near, strict=True):
        inner.setdefault(own, set()).update(p for p in others if linked and own is not None and p is not None and p in depth)
    rising = sorted(inner, key=lambda i: (i is not None and len(i), i or ""))
    for _ in depth:
        deeper = False
        for own in rising:
            level = max((depth[p] + 1 for p in inner[own]), default=0)
            if level > depth[own]:
                depth[own], deeper = level, True
        if not deeper:
            break
    return depth.items()


def _long_levels(evidence: DataFrame) -> DataFrame:
    known = evidence.select("run_id", F.col("id").alias("node")).distinct()
    links = edges(evidence).select("run_id", F.col("parent").alias("node"), F.col("child").alias("next"))
    inner = links.join(known, ["run_id", "node"], "left_semi")
    # The longest way of fewer than 2^(k+1) edges to a node ends in none or 2^k of them.
    longest = cut_lineage(known.withColumn("level", F.lit(0)))
    for span, jumps in _jumps(inner):
        further = longest.join(jumps, ["run_id", "node"]).select("run_id", F.col("next").alias("node"), (F.col("level") + span).cast("int").alias("level"))
        longest = cut_lineage(longest.unionByName(further).groupBy("run_id", "node").agg(F.max("level").alias("level")))
    return longest.select("run_id", F.col("node").alias("id"), "level")
