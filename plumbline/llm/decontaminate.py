"""Benchmark decontamination: broadcast set of benchmark n-grams, verified hits, spans or documents removed.

A window is ``n`` consecutive words of a benchmark item; an item with fewer
words, but not none, is one window.  Every word of a document that lies inside
an occurrence of a window is hit.

The windows are broadcast only in blocks of at most ``block_bytes`` (measured
before); a larger benchmark is scanned block after block, each pass adding to
the hits of the pass before, so a task never holds more than one block.  A
candidate found by its hash counts only after its words were compared.

Defined results: a null or empty text has no words and is clean; an item
without words has no windows; windows of an item whose id is null hit but are
not listed; items with the same id count once; equal rows get equal results;
columns beside id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import plain_words, texts, written

BLOCK_BYTES = 32 << 20
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

HITS = "n_words bigint, hits array<struct<start:int,end:int>>, items array<string>"


class _Zero(dict):
    def __missing__(self, key):
        return 0


def benchmark_windows(benchmark: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (window, item) rows; the words of a window are joined by one blank."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            windows, items = [], []
            for item, text in zip(batch.column(0).to_pylist(), texts(batch, "text"), strict=True):
                words = plain_words(text)
                for at in range(max(1, len(words) - n + 1) if words else 0):
                    windows.append(b" ".join(words[at : at + n]).decode("utf-8", "surrogatepass"))
                    items.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.string()), pa.array(items, pa.string())], ["window", "item"])

    chosen = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(cut, "window string, item string").distinct()


def window_blocks(windows: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list]:
    """The (window, item) rows in blocks of a checked size."""
    size = F.octet_length("window") + F.coalesce(F.octet_length("item"), F.lit(0)) + 64
    total = windows.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for block in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == block)
        yield [(row.window, row.item) for row in part.collect()]


def window_index(rows: list) -> dict:
    """Word numbers and, by length, the sorted hashes, words and items of the windows."""
    vocabulary: dict[bytes, int] = {}
    items = sorted({item for _, item in rows if item is not None})
    number = {item: k for k, item in enumerate(items)}
    owners: dict[tuple, set] = {}
    for window, item in rows:
        words = window.encode("utf-8", "surrogatepass").split()
        key = tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words)
        owners.setdefault(key, set()).update(() if item is None else (number[item],))
    by_length = {}
    for length in sorted({len(key) for key in owners}):
        keys = [key for key in owners if len(key) == length]
        matrix = np.array(keys, np.int64)
        factor = 0x9E3779B97F4A7C15
        while len(np.unique(hashes := _hashes(matrix.T, factor))) < len(keys):
            factor = (factor * 6364136223846793005 + 1442695040888963407) % (1 << 64) | 1
        order = np.argsort(hashes)
        lists = [sorted(owners[keys[k]]) for k in order]
        ends = np.cumsum([0, *map(len, lists)])
        flat = np.array([x for own in lists for x in own], np.int64)
        by_length[length] = (factor, hashes[order], matrix[order], ends, flat)
    return {"vocabulary": vocabulary, "items": items, "lengths": by_length}


def _hashes(columns, factor: int) -> np.ndarray:
    total = np.zeros(len(columns[0]), np.uint64)
    power = 1
    for column in columns:
        total += column.astype(np.uint64) * np.uint64(power)
        power = power * factor % (1 << 64)
    return total


def find_windows(words: list[bytes], lookup: _Zero, lengths: dict) -> tuple[list, set]:
    """Hit ranges of word positions and the numbers of the items behind them."""
    ids = np.fromiter(map(lookup.__getitem__, words), np.int64, len(words))
    known = np.concatenate(([0], np.cumsum(ids > 0)))
    steps = np.zeros(len(words) + 1, np.int64)
    found: set[int] = set()
    for length, (factor, hashes, matrix, ends, flat) in lengths.items():
        if len(words) < length:
            continue
        at = np.flatnonzero(known[length:] - known[:-length] == length)
        if not len(at):
            continue
        wanted = _hashes([ids[at + k] for k in range(length)], factor)
        near = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
        hit = hashes[near] == wanted
        at, near = at[hit], near[hit]
        same = (matrix[near] == ids[at[:, None] + np.arange(length)]).all(axis=1)
        at, near = at[same], near[same]
        np.add.at(steps, at, 1)
        np.add.at(steps, at + length, -1)
        for k in np.unique(near):
            found.update(flat[ends[k] : ends[k + 1]].tolist())
    inside = np.concatenate(([0], np.cumsum(steps)[:-1] > 0, [0])).astype(np.int8)
    edges = np.diff(inside)
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True)), found


def _merged(ranges: list) -> list:
    out: list = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    keep_text: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: number of words, hit ranges of word positions, ids of the items that hit.

    ``keep_text`` also returns the text.
    """
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, n, item_col, item_text)
    state = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("hits"),
        F.expr("cast(array() as array<string>)").alias("items"),
    )
    blocks = window_blocks(windows, block_bytes)
    first = next(blocks)
    later = next(blocks, None)
    state = _scan(state, spark.sparkContext.broadcast(window_index(first)), keep_text or later is not None)
    while later is not None:
        state, _ = written(state, "decontaminate")
        block, later = later, next(blocks, None)
        state = _scan(state, spark.sparkContext.broadcast(window_index(block)), keep_text or later is not None)
    return state


def _scan(state: DataFrame, index, keep_text: bool) -> DataFrame:
    kind = state.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ("text string, " if keep_text else "") + HITS

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value
        lookup, names = _Zero(held["vocabulary"]), held["items"]
        for batch in parts:
            counts, hits, items = [], [], []
            for text, old, own in zip(texts(batch, "text"), batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True):
                words = plain_words(text)
                ranges, found = find_windows(words, lookup, held["lengths"]) if words else ([], set())
                ranges = _merged([*((h["start"], h["end"]) for h in old), *ranges])
                counts.append(len(words))
                hits.append([{"start": a, "end": b} for a, b in ranges])
                items.append(sorted({*own, *(names[k] for k in found)}))
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            columns = {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "n_words": pa.array(counts, pa.int64()), "hits": pa.array(hits, span), "items": pa.array(items, pa.list_(pa.string()))}
            if not keep_text:
                del columns["text"]
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return state.mapInArrow(scan, schema)


def without_spans(text: str | None, ranges: list) -> str | None:
    """The text without the characters of the hit words (and what stands between them)."""
    if not text or not ranges:
        return text
    places = [m.span() for m in _WORD.finditer("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))]
    out, at = [], 0
    for start, end in ranges:
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return "".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "document") -> DataFrame:
    """Documents without benchmark passages, in their own columns.

    ``remove="document"`` drops each document with a hit; ``remove="span"``
    cuts the hit words out of its text and sets ``n_chars`` anew.
    """
    if remove not in ("document", "span"):
        raise ValueError("remove is 'document' or 'span'")
    names = docs.columns
    held = docs.select(F.struct(*names).alias("row"), "text")
    found = contamination(held, benchmark, n, id_col="row", keep_text=True)
    if remove == "document":
        return found.where(F.size("hits") == 0).select("doc_id.*")
    cut = F.udf(lambda text, hits: without_spans(text, [(h["start"], h["end"]) for h in hits]), "string")
    clean = F.when(F.size("hits") > 0, cut("text", "hits")).otherwise(F.col("text"))
    return found.select(
        *[
            clean.alias(c) if c == "text" else F.when(F.size("hits") > 0, F.length(clean).cast("bigint")).otherwise(F.col("doc_id.n_chars")).alias(c) if c == "n_chars" else F.col(f"doc_id.{c}")
            for c in names
        ]
    )


def report(found: DataFrame) -> DataFrame:
    """Digest columns of ``contamination``."""
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda s, h: s + h["end"] - h["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


#: DuckDB SQL of ``report`` for n = 10.
REPORT_SQL = r"""
WITH low AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
grams AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM grams),
windows AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, lengths WHERE len(w) >= n)),
found AS (SELECT r, i, windows.n, item FROM windows JOIN grams ON windows.g = grams.g AND windows.n = grams.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
