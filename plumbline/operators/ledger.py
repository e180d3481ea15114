"""Hash-chained evidence tables.

Evidence is a DataFrame with one row per result, numbered by ``seq`` within a
``run_id`` from 1.  Rows are linked by ``prev_hash`` and ``hash``:

* every row has a content hash over all its fields, computed in parallel;
* ``hash = sha256(prev_hash || content hash)``, and the first row of a run
  links to 64 zeros.

A run is cut into blocks of consecutive rows, so that no task ever holds a
whole run.  A run that fits one block is a plain chain.  In a longer run the
first row of a block links to an anchor: the chain over the digests of all
earlier blocks, built the same way one level up.  Changing, dropping or moving
any row changes its block digest and with it every later anchor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import cut_lineage

GENESIS = "0" * 64
BLOCK = 256
_CHAIN_COLUMNS = ("prev_hash", "hash", "content_hash")


def evidence_id(seq: Column) -> Column:
    """ev_0001, ...; numbers above 9999 are written in full."""
    return F.format_string("ev_%04d", seq)


def id_number(evidence_id: Column) -> Column:
    return F.substring(evidence_id, 4, 18).cast("bigint")


def _sized(text: Column) -> Column:
    return F.concat(F.length(text).cast("string"), F.lit(":"), text)


def canonical(col: Column, data_type: T.DataType) -> Column:
    """Unambiguous text: sized scalars, ordered arrays, maps in key order."""
    if isinstance(data_type, T.ArrayType):
        body = F.array_join(F.transform(col, lambda x: canonical(x, data_type.elementType)), ",")
        return F.coalesce(F.concat(F.lit("["), body, F.lit("]")), F.lit("~"))
    if isinstance(data_type, T.MapType):
        entries = F.array_sort(F.map_entries(col))
        body = F.array_join(
            F.transform(
                entries,
                lambda e: F.concat(
                    canonical(e["key"], data_type.keyType), F.lit("="), canonical(e["value"], data_type.valueType)
                ),
            ),
            ",",
        )
        return F.coalesce(F.concat(F.lit("{"), body, F.lit("}")), F.lit("~"))
    if isinstance(data_type, T.StructType):
        body = F.concat_ws(",", *[F.concat(F.lit(f"{f.name}="), canonical(col[f.name], f.dataType)) for f in data_type.fields])
        return F.when(col.isNull(), "~").otherwise(F.concat(F.lit("("), body, F.lit(")")))
    if isinstance(data_type, T.VariantType):
        text = F.to_json(col)
    elif isinstance(data_type, T.TimestampType):
        # an instant: its text would depend on the session's time zone
        text = F.unix_micros(col).cast("string")
    elif isinstance(data_type, T.BinaryType):
        text = F.hex(col)
    else:
        text = col.cast("string")
    return F.coalesce(_sized(text), F.lit("~"))


def content_hash(evidence: DataFrame) -> Column:
    """SHA-256 over all content fields in name order."""
    fields = sorted((f for f in evidence.schema.fields if f.name not in _CHAIN_COLUMNS), key=lambda f: f.name)
    parts = [F.concat(F.lit(f"{f.name}="), canonical(F.col(f"`{f.name}`"), f.dataType)) for f in fields]
    return F.sha2(F.concat_ws("\n", *parts), 256)


def canonical_json_hash(json_text: Column) -> Column:
    """Hash of a JSON document that ignores key order and white space."""
    return F.sha2(F.to_json(F.parse_json(json_text)), 256)


def _link(state: Column, item: Column) -> Column:
    return F.sha2(F.concat(state, item), 256)


def _states(items: Column, start: Column) -> Column:
    """Chain states before each item and after the last one."""
    return F.aggregate(
        items, F.array(start), lambda acc, item: F.array_append(acc, _link(F.element_at(acc, -1), item["h"]))
    )


def _by_idx(items: Column) -> Column:
    """Items in the order of ``idx``, whatever else they hold."""
    return F.array_sort(items, lambda x, y: F.when(x["idx"] < y["idx"], -1).when(x["idx"] > y["idx"], 1).otherwise(0))


def _with_blocks(hashes: DataFrame, block: int) -> DataFrame:
    """One row per block: its items in order (at most ``block`` of them)."""
    return hashes.groupBy("run_id", F.floor(F.col("idx") / block).alias("b")).agg(
        F.array_sort(F.collect_list(F.struct("idx", *[c for c in hashes.columns if c not in ("run_id", "idx")]))).alias("items")
    )


def _anchored_blocks(hashes: DataFrame, longest: int, block: int) -> DataFrame:
    """Blocks with the chain state their first item links to."""
    blocks = _with_blocks(hashes, block)
    if longest <= block:
        return blocks.withColumn("start", F.lit(GENESIS))
    zeros = F.lit(GENESIS)
    digests = blocks.select(
        "run_id",
        F.col("b").alias("idx"),
        F.aggregate("items", zeros, lambda acc, item: _link(acc, item["h"])).alias("h"),
    )
    upper = _anchored_blocks(digests, -(-longest // block), block)
    starts = upper.withColumn("s", _states(F.col("items"), F.col("start"))).select(
        "run_id", F.posexplode("items").alias("i", "item"), "s"
    )
    anchors = starts.select("run_id", F.col("item.idx").alias("b"), F.element_at("s", F.col("i") + 1).alias("start"))
    return blocks.join(anchors, ["run_id", "b"])


def _longest_run(hashes: DataFrame) -> int:
    return (hashes.agg(F.max("idx").alias("m")).first()["m"] or 0) + 1


def _chain(hashes: DataFrame, block: int) -> DataFrame:
    """Adds ``expected_prev`` and ``expected_hash`` to (run_id, idx, h, ...).

    Run lengths are known without a hash.  Where a run needs several blocks the
    hashes are written out, since they are then read once per level.
    """
    longest = _longest_run(hashes)
    if longest > block:
        hashes = cut_lineage(hashes)
    blocks = _anchored_blocks(hashes, longest, block)
    rows = blocks.withColumn("s", _states(F.col("items"), F.col("start"))).select(
        "run_id", F.posexplode("items").alias("i", "item"), "s"
    )
    return rows.select(
        "run_id",
        "item.*",
        F.element_at("s", F.col("i") + 1).alias("expected_prev"),
        F.element_at("s", F.col("i") + 2).alias("expected_hash"),
    )


def _chain_in_place(numbered: DataFrame, columns: list[str]) -> DataFrame:
    """Runs of one block each, linked while their rows are together."""
    kept = [c for c in columns if c not in ("run_id", "seq")]
    hashed = numbered.select("run_id", F.col("seq").alias("idx"), content_hash(numbered).alias("h"), F.struct(*kept).alias("row"))
    runs = hashed.groupBy("run_id").agg(_by_idx(F.collect_list(F.struct("idx", "h", "row"))).alias("items"))
    linked = runs.withColumn("s", _states(F.col("items"), F.lit(GENESIS))).select("run_id", F.posexplode("items").alias("i", "item"), "s")
    return linked.select(
        "run_id", F.col("item.idx").alias("seq"), "item.row.*", F.col("item.h").alias("content_hash"),
        F.element_at("s", F.col("i") + 1).alias("prev_hash"), F.element_at("s", F.col("i") + 2).alias("hash"),
    )


def ledger_append(batch: DataFrame, existing: DataFrame | None = None, block: int = BLOCK, columns: list[str] | None = None) -> DataFrame:
    """Number and chain a batch of evidence, after the rows already in the ledger.

    ``batch`` holds content columns with ``seq`` giving the order within its
    run, from 1.  With ``existing`` the batch continues those runs.  The result
    has the batch rows with ``id, seq, content_hash, prev_hash, hash``; of their
    content, all of which is hashed, only ``columns`` where they are given.
    """
    if columns is None:
        columns = [*batch.columns, *["id"][: "id" not in batch.columns]]
    if existing is None:
        rows, last = batch.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("m")).agg(F.max("n"), F.max("m")).first()
        if max(rows or 0, last or 0) <= block:
            return _chain_in_place(batch.withColumn("id", evidence_id(F.col("seq"))), columns)
    numbered = batch
    if existing is not None:
        lengths = existing.groupBy("run_id").agg(F.max("seq").alias("_offset"))
        numbered = (
            batch.join(lengths, "run_id", "left")
            .withColumn("seq", F.col("seq") + F.coalesce("_offset", F.lit(0)))
            .drop("_offset")
        )
    numbered = numbered.withColumn("id", evidence_id(F.col("seq")))
    fresh = numbered.select(
        "run_id", (F.col("seq") - 1).alias("idx"), content_hash(numbered).alias("h"), F.lit(True).alias("new")
    )
    if existing is not None:
        touched = existing.join(batch.select("run_id").distinct(), "run_id", "left_semi")
        fresh = fresh.unionByName(
            touched.select(
                "run_id", (F.col("seq") - 1).alias("idx"), F.col("content_hash").alias("h"), F.lit(False).alias("new")
            )
        )
    chained = _chain(fresh, block).where("new")
    links = chained.select(
        "run_id",
        (F.col("idx") + 1).alias("seq"),
        F.col("h").alias("content_hash"),
        F.col("expected_prev").alias("prev_hash"),
        F.col("expected_hash").alias("hash"),
    )
    kept = [c for c in columns if c not in ("run_id", "seq")]
    return numbered.select("run_id", "seq", *kept).join(links, ["run_id", "seq"])


def ledger_verify(ledger: DataFrame, headers: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Per run: is the chain intact, and the first row that is not.

    Content hashes are recomputed, the chain is rebuilt from them and compared
    with the stored links.  Missing or repeated numbers fail too.  ``headers``
    (run_id, expected_count) also catches rows cut off at the end.
    """
    hashes = ledger.select(
        "run_id",
        (F.col("seq") - 1).alias("idx"),
        content_hash(ledger).alias("h"),
        F.col("prev_hash").alias("stored_prev"),
        F.col("hash").alias("stored_hash"),
    )
    rebuilt = _chain(hashes, block)
    broken = ~(
        F.col("expected_prev").eqNullSafe(F.col("stored_prev")) & F.col("expected_hash").eqNullSafe(F.col("stored_hash"))
    )
    per_run = rebuilt.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("evidence_count"),
        F.max(F.col("idx") + 1).alias("_last"),
        F.min(F.when(broken, F.col("idx") + 1)).alias("first_bad_seq"),
    )
    gapless = F.col("_last") == F.col("evidence_count")
    valid = F.col("first_bad_seq").isNull() & gapless
    if headers is not None:
        per_run = per_run.join(headers.select("run_id", "expected_count"), "run_id", "full_outer")
        per_run = per_run.withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0)))
        valid = valid & (F.col("evidence_count") == F.col("expected_count"))
    return per_run.select(
        "run_id", "evidence_count", F.coalesce(valid, F.lit(False)).alias("chain_valid"), "first_bad_seq"
    )


def ledger_recent(ledger: DataFrame, limit: int = 50) -> DataFrame:
    """The latest rows over all runs."""
    columns = ["id", "run_id", "seq", "kind", "produced_by", "status", "created_at", "prev_hash", "hash"]
    return ledger.select(*columns).orderBy(F.desc("created_at"), "run_id", F.desc("seq")).limit(limit)


def list_evidence(ledger: DataFrame, run_id: str | None = None) -> DataFrame:
    """Evidence in numeric id order, of one run or all."""
    chosen = ledger if run_id is None else ledger.where(F.col("run_id") == run_id)
    return chosen.orderBy("run_id", id_number(F.col("id")))


def get_evidence(ledger: DataFrame, run_id: str, evidence_id: str) -> DataFrame:
    return ledger.where((F.col("run_id") == run_id) & (F.col("id") == evidence_id))


def ledger_totals(ledger: DataFrame, kind: str | None = None, run_id: str | None = None) -> DataFrame:
    """Records per kind, with the number of runs they come from."""
    chosen = ledger
    if kind is not None:
        chosen = chosen.where(F.col("kind") == kind)
    if run_id is not None:
        chosen = chosen.where(F.col("run_id") == run_id)
    per_run = chosen.groupBy("kind", "run_id").agg(F.count(F.lit(1)).alias("n"))
    return per_run.groupBy("kind").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("runs"))


def run_summary(ledger: DataFrame, headers: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Per run: chain state, evidence count and the dataset it ran on."""
    datasets = ledger.groupBy("run_id").agg(F.min("dataset_hash").alias("dataset_hash"))
    return ledger_verify(ledger, headers, block).join(datasets, "run_id", "left")


def audit_trail(ledger: DataFrame, exportable_only: bool = False) -> DataFrame:
    """Short form of every row; ``exportable_only`` keeps rows with own code."""
    chosen = ledger
    if exportable_only:
        chosen = exportable(ledger)
    return chosen.select(
        "run_id",
        "id",
        "kind",
        "produced_by",
        F.col("seq").alias("execution_order"),
        "status",
        F.coalesce("purpose", F.lit("")).alias("purpose"),
        F.concat(F.substring(F.coalesce("hash", F.lit("")), 1, 12), F.lit("...")).alias("short_hash"),
    )


# Codes of rows written by the workflow itself.
BOILERPLATE_CODES = ("synthesis", "report_synthesis", "evaluator_threshold_checks")


def exportable(ledger: DataFrame) -> DataFrame:
    """Rows whose code belongs into a reproducible script."""
    code = F.coalesce("code", F.lit(""))
    return ledger.where(F.col("exportable") & (code != "") & ~code.isin(*BOILERPLATE_CODES))
