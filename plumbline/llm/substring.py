"""Substring dedup by relative Lempel-Ziv parsing against an index of all documents.

The reference is every document, cut into index blocks by the hash of a
window of ``width`` consecutive words.  An index block knows for each of its
windows the first occurrence: the smallest doc_id and the place in it.  Each
window of a document is looked up by its hash.  A factor starts at the first word
whose window occurs in a document with a smaller id and runs as long as the
first occurrences of the next windows continue the same reference text; it ends
where the next window has a still earlier one, so factors are not the longest
matches: extending them would need the reference texts beside each document.
A word is removed if and only if a window over it starts in an earlier document.

Work is dealt as packed blocks.  A task sends each index block one row with
its window hashes (steps of sorted numbers) and places; the index block
answers each document block with the places that repeat; only those answers,
a few bytes per repeated window, travel on.  A passage that a third of all
documents share is one group of numbers inside an index block, never pairs of
documents.  The number of index blocks grows with the text.

Windows are told apart by 64-bit hashes: with 10^13 windows about one in a
million is expected to share its hash with another.

Defined results: a null or empty text has no words; a text under ``width``
words has no window and is kept; rows with the same id are one document's
copies and do not remove each other; a null id counts as larger than any
other; columns beside id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import (
    encoded,
    index_block,
    packed_ints,
    packed_sorted,
    rolling,
    task_block,
    texts,
    unpacked_ints,
    unpacked_sorted,
    word_hashes,
)

WIDTH = 13
#: Text bytes behind an index block, and words of a document block.
INDEX_BYTES = 8 << 20
BLOCK_WORDS = 4_000_000
LEAST_INDEX_BLOCKS = 64

_LAST = np.iinfo(np.int64).max
_SENT = "index int, block bigint, docs binary, keys binary, starts binary, hashes binary, places binary"
_ANSWER = "block bigint, docs binary, keys binary, starts binary, places binary, source binary, source_places binary"


def _packed_ids(ids: np.ndarray) -> bytes:
    return ids.astype("<i8").tobytes()


def _sent(docs: DataFrame, width: int, index_blocks: int) -> DataFrame:
    """Rows for the index blocks, and one with the documents of each document block (a negative index)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = task_block() << 24, 0
        held: list = []
        words = 0

        def out() -> Iterator[pa.RecordBatch]:
            block = task + number
            held.sort(key=lambda d: d[0])
            ids = np.array([d[0] for d in held], np.int64)
            keys = np.array([d[1] for d in held], np.int64)
            sizes = np.array([len(d[2]) for d in held], np.int64)
            starts = np.concatenate(([0], np.cumsum(sizes)))
            yield _row(_SENT_TYPE, index=-1 - block % index_blocks, block=block, docs=_packed_ids(ids), keys=_packed_ids(keys), starts=packed_sorted(starts))
            hashes = np.concatenate([d[2] for d in held])
            held.clear()
            own = index_block(hashes, index_blocks)
            order = np.argsort(hashes, kind="stable")
            own, hashes = own[order], hashes[order]
            cuts = np.searchsorted(own, np.arange(index_blocks + 1))
            for k in range(index_blocks):
                a, b = cuts[k], cuts[k + 1]
                if a < b:
                    at = order[a:b]
                    doc = np.searchsorted(starts, at, "right") - 1
                    # numbers of the documents in this row, their ids, and the places inside them
                    used, which = np.unique(doc, return_inverse=True)
                    yield _row(
                        _SENT_TYPE,
                        index=k,
                        block=block,
                        docs=packed_sorted(ids[used].astype(np.uint64)) if (ids[used] >= 0).all() else b"raw" + _packed_ids(ids[used]),
                        keys=packed_ints(which),
                        starts=packed_sorted(used),
                        hashes=packed_sorted(hashes[a:b]),
                        places=packed_ints(at - starts[doc]),
                    )

        for batch in parts:
            ids = batch.column(0).to_pylist()
            keys = batch.column(1).to_pylist()
            for doc, key, text in zip(ids, keys, texts(batch, "text"), strict=True):
                windows = rolling(word_hashes(encoded(text)), width)
                if len(windows):
                    held.append((_LAST if doc is None else doc, key, windows))
                    words += len(windows)
                if words >= BLOCK_WORDS:
                    yield from out()
                    number, words = number + 1, 0
        if held:
            yield from out()

    return docs.mapInArrow(run, _SENT)


_SENT_TYPE = pa.schema(
    [("index", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("docs", "keys", "starts", "hashes", "places"))]
)
_ANSWER_TYPE = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("docs", "keys", "starts", "places", "source", "source_places"))])


def _row(schema: pa.Schema, **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([values], schema)


def _rows(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in parts:
        for k in range(batch.num_rows):
            yield {name: batch.column(name)[k].as_py() for name in batch.schema.names}


def _grouped(rows: Iterator[dict], key: str) -> Iterator[tuple]:
    """Runs of rows with the same key."""
    held, own = [], None
    for row in rows:
        if held and row[key] != own:
            yield own, held
            held = []
        own = row[key]
        held.append(row)
    if held:
        yield own, held


def _doc_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data[3:], "<i8") if data[:3] == b"raw" else unpacked_sorted(data).astype(np.int64)


def _answers(sent: DataFrame) -> DataFrame:
    """From the index blocks: the places of each document block that repeat an earlier document."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for index, rows in _grouped(_rows(parts), "index"):
            if index < 0:
                for r in rows:
                    yield _row(_ANSWER_TYPE, block=r["block"], docs=r["docs"], keys=r["keys"], starts=r["starts"])
                continue
            hashes = [unpacked_sorted(r["hashes"]) for r in rows]
            which = [unpacked_ints(r["keys"]).astype(np.int64) for r in rows]
            docs = [_doc_ids(r["docs"])[w] for r, w in zip(rows, which, strict=True)]
            places = [unpacked_ints(r["places"]).astype(np.int64) for r in rows]
            ends = np.cumsum([0, *map(len, hashes)])
            all_hashes, all_docs, all_places = np.concatenate(hashes), np.concatenate(docs), np.concatenate(places)
            order = np.argsort(all_hashes, kind="stable")
            ordered = all_hashes[order]
            first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
            # only hashes that occur more than once can repeat
            sizes = np.diff(np.append(first, len(ordered)))
            many = np.repeat(sizes > 1, sizes)
            order = order[many]
            sizes = sizes[sizes > 1]
            if not len(order):
                continue
            group = np.repeat(np.arange(len(sizes)), sizes)
            best = np.lexsort((all_places[order], all_docs[order], group))
            lead = order[best[np.concatenate(([0], np.cumsum(sizes)[:-1]))]]
            source = np.repeat(lead, sizes)
            repeats = all_docs[order] > all_docs[source]
            at, source = order[repeats], source[repeats]
            rank = np.argsort(at)
            at, source = at[rank], source[rank]
            cuts = np.searchsorted(at, ends)
            for k, r in enumerate(rows):
                a, b = cuts[k], cuts[k + 1]
                if a < b:
                    own = at[a:b] - ends[k]
                    number = unpacked_sorted(r["starts"]).astype(np.int64)[which[k][own]]
                    # (document of the block, place in it) as one number, rising
                    spot = (number << 32) | places[k][own]
                    turn = np.argsort(spot)
                    yield _row(
                        _ANSWER_TYPE,
                        block=r["block"],
                        places=packed_sorted(spot[turn]),
                        source=packed_ints(all_docs[source[a:b]][turn].view(np.uint64)),
                        source_places=packed_ints(all_places[source[a:b]][turn]),
                    )

    return sent.repartition("index").sortWithinPartitions("index", "block").mapInArrow(run, _ANSWER)


_FACTORS = "array<struct<start:int,length:int,source:bigint,source_start:int>>"


def _factors(answers: DataFrame, width: int) -> DataFrame:
    """One row per document with repeats: its factors."""
    factor = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("factors", pa.list_(factor))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(_rows(parts), "block"):
            (held,) = [r for r in rows if r["docs"] is not None]
            own = [r for r in rows if r["docs"] is None]
            if not own:
                continue
            ids, keys = np.frombuffer(held["docs"], "<i8"), np.frombuffer(held["keys"], "<i8")
            spot = np.concatenate([unpacked_sorted(r["places"]) for r in own]).astype(np.int64)
            source = np.concatenate([unpacked_ints(r["source"]) for r in own]).view(np.int64)
            place = np.concatenate([unpacked_ints(r["source_places"]) for r in own]).astype(np.int64)
            turn = np.argsort(spot)
            spot, source, place = spot[turn], source[turn], place[turn]
            # a factor goes on while document and reference both go one word further
            on = (np.diff(spot) == 1) & (np.diff(place) == 1) & (np.diff(source) == 0)
            heads = np.flatnonzero(np.concatenate(([True], ~on)))
            tails = np.append(heads[1:], len(spot))
            doc = spot[heads] >> 32
            flat = pa.StructArray.from_arrays(
                [
                    pa.array((spot[heads] & 0xFFFFFFFF).astype(np.int32)),
                    pa.array((tails - heads + width - 1).astype(np.int32)),
                    pa.array(source[heads]),
                    pa.array(place[heads].astype(np.int32)),
                ],
                fields=list(factor),
            )
            used, at = np.unique(doc, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(doc)).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[used], mask=ids[used] == _LAST), pa.array(keys[used]), lists.cast(pa.list_(factor))], schema=schema
            )

    dealt = answers.repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, f"doc_id bigint, key bigint, factors {_FACTORS}")


def repeated(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with its text and factors: (start, length) in words, and where the text stood first.

    A reference is given for each factor: ``source`` is a smaller id, and the
    words from ``source_start`` on are the factor's.
    """
    chosen = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.xxhash64(F.col(text_col).cast("string")).alias("key"),
        F.col(text_col).cast("string").alias("text"),
    )
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    index_blocks = max(LEAST_INDEX_BLOCKS, -(-size // INDEX_BYTES))
    found = _factors(_answers(_sent(chosen, width, index_blocks)), width)
    # equal rows have equal factors
    found = found.groupBy("doc_id", "key").agg(F.first("factors").alias("factors"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "factors")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    return chosen.join(found, same, "left").select("doc_id", "text", "factors")


def kept_words(text: str | None, factors: list | None) -> tuple[int, list[bytes]]:
    """Number of words, and the words outside all factors."""
    words = encoded(text).split()
    if not factors:
        return len(words), words
    steps = np.zeros(len(words) + 1, np.int64)
    for f in factors:
        steps[f["start"]] += 1
        steps[f["start"] + f["length"]] -= 1
    gone = np.cumsum(steps)[:-1] > 0
    return len(words), [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def report(found: DataFrame) -> DataFrame:
    """Digest columns of ``repeated``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            counts, gone, digests = [], [], []
            factors = batch.column("factors")
            for k, text in enumerate(texts(batch, "text")):
                n, kept = kept_words(text, factors[k].as_py())
                counts.append(n)
                gone.append(n - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests)], schema=schema)

    return found.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


#: DuckDB SQL of ``report`` for width = 13.
REPORT_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS rank_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
windows AS (
  SELECT r, rank_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS g
  FROM (SELECT r, rank_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
firsts AS (SELECT g, min(rank_id) AS first_id FROM windows GROUP BY g),
gone AS (
  SELECT r, list(DISTINCT p) AS ps
  FROM (SELECT r, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (g) WHERE first_id < rank_id) GROUP BY r),
words AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
removed AS (SELECT r, unnest(ps) AS p FROM gone),
kept AS (
  SELECT words.r, string_agg(x, ' ' ORDER BY words.p) AS t, count(*) AS n
  FROM words LEFT JOIN removed ON words.r = removed.r AND words.p = removed.p WHERE removed.p IS NULL GROUP BY words.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
