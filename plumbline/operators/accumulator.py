"""Appending to a hash-chained ledger, and verifying it, from a few hashes per run.

The chain of ``ledger`` is cut into blocks, blocks of blocks, and so on.  A
complete block never changes, so what later rows need of a run are its peaks:
the row hashes of the last, open block, the digests of complete blocks in the
open block one level up, and so on, fewer than a block's length on each level.
They are kept as a table beside the ledger,

    run_id, block (the block length of the run), level, idx, h

which says how long every run is and lets a batch be chained, or new rows be
verified, without reading older rows.  The links are those that chaining the
whole run gives.

With ``flat`` the digests of all complete blocks of a run form one chain.  Its
peaks are the row hashes of the open block and one row of level -1: the state of
that chain after ``idx`` complete blocks.  Runs of up to ``block ** 2`` rows have
the same links in both forms.  A chain has no parallel form, so the digests of a
run, one for ``block`` rows, stream in order through one task, which holds one
state; rows are hashed and linked block by block on all tasks.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ledger import BLOCK, GENESIS, _by_idx, _link, _states, content_hash, evidence_id
from plumbline.session import cut_lineage

PEAKS = "run_id string, block int, level int, idx bigint, h string"
STATE = -1


def no_peaks(spark) -> DataFrame:
    return spark.createDataFrame([], PEAKS)


def run_lengths(peaks: DataFrame) -> DataFrame:
    """run_id, block and number of rows of every run.

    A peak of level k stands for block ** k rows, the state of a flat chain for ``idx`` blocks.
    """
    one = F.pow(F.col("block").cast("double"), F.col("level")).cast("bigint")
    rows = F.sum(F.when(F.col("level") == STATE, F.col("idx") * F.col("block")).otherwise(one))
    return peaks.groupBy("run_id", "block").agg(rows.alias("n"))


def _blocks(items: DataFrame) -> DataFrame:
    """One row per block with its items in order."""
    held = _by_idx(F.collect_list(F.struct(*[c for c in items.columns if c not in ("run_id", "block")])))
    return items.groupBy("run_id", "block", F.expr("idx div block").alias("b")).agg(held.alias("items"))


def _digest() -> Column:
    return F.aggregate("items", F.lit(GENESIS), lambda acc, item: _link(acc, item["h"]))


def _touched(peaks: DataFrame, rows: DataFrame) -> DataFrame:
    return peaks.join(rows.select("run_id").distinct(), "run_id", "left_semi")


def _row_blocks(leaves: DataFrame, peaks: DataFrame) -> DataFrame:
    """Blocks of rows with their digests: open ones from their peaks, and all that ``leaves`` (run_id, block, idx, h, row) completes or begins.

    The rows travel in their blocks, so that links need no join to come back to them.
    """
    kind = leaves.schema["row"].dataType
    own = peaks.where("level = 0").select("run_id", "block", "idx", "h", F.lit(False).alias("new"), F.lit(None).cast(kind).alias("row"))
    items = leaves.select("run_id", "block", "idx", "h", F.lit(True).alias("new"), "row")
    blocks = _blocks(items.unionByName(own)).where(F.exists("items", lambda item: item["new"]))
    return cut_lineage(blocks.withColumns({"full": F.size("items") == F.col("block"), "d": _digest()}))


def _upper_levels(rows: DataFrame, peaks: DataFrame) -> list[DataFrame]:
    """Blocks of digests, level by level, until one holds them all."""
    longest = rows.agg(F.max(F.ceil(F.log((F.col("b") + 1) * F.col("block") + 1.0) / F.log(F.col("block").cast("double")))).alias("k")).first()["k"] or 0
    own = _touched(peaks, rows)
    full = rows.where("full").select("run_id", "block", F.col("b").alias("idx"), F.col("d").alias("h"))
    out = []
    for level in range(1, int(longest) + 1):
        blocks = cut_lineage(_blocks(full.unionByName(own.where(F.col("level") == level).drop("level"))))
        out.append(blocks)
        full = blocks.where(F.size("items") == F.col("block")).select("run_id", "block", F.col("b").alias("idx"), _digest().alias("h"))
    return out


def _starts(rows: DataFrame, upper: list[DataFrame]) -> DataFrame:
    """run_id, b, start: the chain state that the first row of each block of rows links to."""
    needed = [rows.select("run_id", "block", "b")]
    for _ in upper:
        needed.append(needed[-1].select("run_id", "block", F.expr("b div block").alias("b")).distinct())
    starts = needed[-1].withColumn("start", F.lit(GENESIS))
    none = F.array().cast("array<struct<idx:bigint,h:string>>")
    for k in range(len(upper) - 1, -1, -1):
        above = starts.join(upper[k].select("run_id", "b", "items"), ["run_id", "b"], "left")
        above = above.select("run_id", F.col("b").alias("up"), _states(F.coalesce("items", none), F.col("start")).alias("s"))
        below = needed[k].withColumn("up", F.expr("b div block"))
        offset = (F.col("b") - F.col("up") * F.col("block") + 1).cast("int")
        starts = below.join(above, ["run_id", "up"]).select("run_id", "block", "b", F.try_element_at("s", offset).alias("start"))
    return starts.select("run_id", "b", "start")


def _flat_states(batches):
    """The chain state before and after each block digest; none behind a block that is missing or not full."""
    run, following, state = None, 0, None
    for rows in batches:
        before, after = [], []
        for run_id, b, full, d, done, reached in zip(rows.run_id, rows.b, rows.full, rows.d, rows.done, rows.reached, strict=True):
            if run_id != run:
                run, following, state = run_id, done, reached
            state = state if b == following else None
            before.append(state)
            state = hashlib.sha256((state + d).encode()).hexdigest() if state and full else None
            after.append(state)
            following = b + 1
        yield rows.assign(start=before, after=after)[["run_id", "block", "b", "start", "after"]]


def _flat_starts(rows: DataFrame, peaks: DataFrame) -> DataFrame:
    """run_id, block, b, start, after: states of the chain over all block digests of a run."""
    known = peaks.where(F.col("level") == STATE).select("run_id", F.col("idx").alias("done"), F.col("h").alias("reached"))
    items = rows.select("run_id", "block", "b", "full", "d").join(known, "run_id", "left")
    items = items.withColumns({"done": F.coalesce("done", F.lit(0).cast("bigint")), "reached": F.coalesce("reached", F.lit(GENESIS))})
    ordered = items.repartition("run_id").sortWithinPartitions("run_id", "b")
    return cut_lineage(ordered.mapInPandas(_flat_states, "run_id string, block int, b bigint, start string, after string"))


def _links(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """run_id, idx, h, row, prev_hash, hash of the new rows."""
    linked = rows.select("run_id", "b", "items").join(starts.select("run_id", "b", "start"), ["run_id", "b"])
    linked = linked.withColumn("s", _states(F.col("items"), F.col("start")))
    linked = linked.select("run_id", F.posexplode("items").alias("i", "item"), "s").where("item.new")
    return linked.select(
        "run_id", "item.idx", "item.h", "item.row", F.element_at("s", F.col("i") + 1).alias("prev_hash"), F.element_at("s", F.col("i") + 2).alias("hash")
    )


def _chained(leaves: DataFrame, peaks: DataFrame, flat: bool) -> tuple[DataFrame, DataFrame]:
    """The links of ``leaves`` after their peaks, and the peaks of all runs with them."""
    other_form = F.col("level") > 0 if flat else F.col("level") == STATE
    if not peaks.where(other_form).isEmpty():
        raise ValueError("the peaks are of the other form: flat must stay as it was when their runs began")
    rows = _row_blocks(leaves, peaks)
    level = lambda k: F.lit(k).alias("level")
    opened = [rows.where("not full").select("run_id", "block", level(0), F.inline("items")).drop("new", "row")]
    if flat:
        starts = _flat_starts(rows, peaks)
        reached = starts.where("after is not null").groupBy("run_id", "block")
        reached = reached.agg((F.max("b") + 1).alias("idx"), F.max_by("after", "b").alias("h"))
        earlier = _touched(peaks.where(F.col("level") == STATE), rows).join(reached.select("run_id"), "run_id", "left_anti")
        opened += [reached.select("run_id", "block", level(STATE), "idx", "h"), earlier.select("run_id", "block", "level", "idx", "h")]
    else:
        upper = _upper_levels(rows, peaks)
        starts = _starts(rows, upper)
        opened += [
            blocks.where(F.size("items") < F.col("block")).select("run_id", "block", level(k), F.inline("items"))
            for k, blocks in enumerate(upper, 1)
        ]
    untouched = peaks.join(rows.select("run_id").distinct(), "run_id", "left_anti")
    return _links(rows, starts), cut_lineage(reduce(DataFrame.unionByName, [*opened, untouched]))


def _continued(rows: DataFrame, peaks: DataFrame, block: int) -> tuple[DataFrame, Column]:
    """Rows with the length ``_n`` of their run so far, and its block length."""
    known = run_lengths(peaks).withColumnsRenamed({"n": "_n", "block": "_block"})
    return rows.join(known, "run_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0))), F.coalesce(F.col("_block"), F.lit(block)).cast("int")


def extend(batch: DataFrame, peaks: DataFrame, block: int = BLOCK, flat: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows of ``batch`` numbered and chained after their runs, and the peaks of all runs with them.

    ``batch`` holds content columns with ``seq`` from 1 in its own order.  Only
    ``peaks`` is read of what the ledger holds; runs it does not know begin with
    blocks of ``block`` rows, others go on with their own.
    """
    joined, width = _continued(batch, peaks, block)
    numbered = joined.withColumn("seq", F.col("seq") + F.col("_n"))
    numbered = numbered.withColumn("id", evidence_id(F.col("seq")))
    content = [c for c in numbered.columns if c not in ("_n", "_block")]
    carried = [c for c in content if c not in ("run_id", "seq")]
    leaves = numbered.select(
        "run_id", width.alias("block"), (F.col("seq") - 1).cast("bigint").alias("idx"),
        content_hash(numbered.select(*content)).alias("h"), F.struct(*carried).alias("row"),
    )
    links, grown = _chained(leaves, peaks, flat)
    seq = (F.col("idx") + 1).alias("seq")
    return links.select("run_id", seq, "row.*", F.col("h").alias("content_hash"), "prev_hash", "hash"), grown


def resume(ledger: DataFrame, verified: DataFrame, block: int = BLOCK, flat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Per run, whether the rows after the verified peaks are intact, and the peaks with them.

    Content hashes of the later rows are recomputed and chained on the verified
    peaks; links that differ, gaps and repeated numbers are faults.  Rows that
    the peaks stand for are not read; verify them with no peaks.
    """
    joined, width = _continued(ledger, verified, block)
    later = joined.where(F.col("seq") > F.col("_n"))
    hashed = later.select(
        "run_id", width.alias("block"), (F.col("seq") - 1).cast("bigint").alias("idx"),
        content_hash(later.drop("_n", "_block")).alias("h"), "prev_hash", "hash", F.col("_n").alias("n"),
    )
    # A number that is repeated stays one item; its rows must all hold the one link that is expected.
    ends = {f"{side}_{c}": getattr(F, side)(c) for c in ("prev_hash", "hash") for side in ("min", "max")}
    once = hashed.groupBy("run_id", "block", "idx").agg(
        F.min("h").alias("h"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("prev_hash").isNull() | F.col("hash").isNull()).alias("bare"),
        F.max("n").alias("n"), *[c.alias(name) for name, c in ends.items()],
    )
    leaves = once.select("run_id", "block", "idx", "h", F.struct("rows", "bare", "n", *ends).alias("row"))
    links, grown = _chained(leaves, verified, flat)
    stored = lambda c: [F.col(f"row.{side}_{c}") == F.col(c) for side in ("min", "max")]
    same = reduce(Column.__and__, [F.col("row.bare") == 0, *stored("prev_hash"), *stored("hash")])
    found = links.groupBy("run_id").agg(
        F.sum("row.rows").alias("checked_rows"),
        (F.max("idx") + 1 - F.max("row.n")).alias("_span"),
        F.count(F.lit(1)).alias("_distinct"),
        F.min(F.when(~F.coalesce(same, F.lit(False)), F.col("idx") + 1)).alias("first_bad_seq"),
    )
    whole = (F.col("_span") == F.col("checked_rows")) & (F.col("_distinct") == F.col("checked_rows"))
    valid = F.col("first_bad_seq").isNull() & whole
    return found.select("run_id", "checked_rows", valid.alias("chain_valid"), "first_bad_seq"), grown
