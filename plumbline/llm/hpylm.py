"""Hierarchical Pitman-Yor language model, seated by blocked Gibbs sampling, over tables.

One restaurant serves each context class, the hash of the word before cut to
``CLASS_BITS`` bits; all of them share one parent, the restaurant of single
words, whose base is uniform over the training words and one unknown word.
Words are not limited: what is counted grows with the corpus.

Seating.  A customer is a training token; the tables that serve word w in
context u are sampled by blocked Gibbs: the number of tables of the whole group is
drawn at once, given all others.  Its weights sum those of all seatings, where a
customer joins a table in proportion to its size less the discount, or opens one in
proportion to (strength + discount * tables of u) * P(w).  A new table sends a
customer to the parent, which is seated in the same way.  The customers of a word in a
context are independent of all others given the number of tables of the context
and P(w), so index blocks by word are sampled in parallel: P(w) and the tables
of a word are kept in its block, the tables of each context are those of the
round before.  Each round goes on from the seating of the one before, with ``BURN_IN``
sweeps over pairs and parent before a sample is kept.  The time of a large group grows with the spread of its number of
tables, not with its customers, so no word pair can hold up a task.  Discounts
follow from the counts of counts.  The probability of a token is the average over the samples
of the last round, each with the exact totals of its own seating, so every
sample is a distribution.

Work is dealt as packed blocks, as numbers rather than rows: a document block
sends each index block its distinct (word, class) pairs; the index block merges
them, keeps which pairs each block asked for, and answers with one probability
for each.  Documents are scored where their block lies.

Defined results: a null or empty text is its end token alone; rows with equal
id and text count and score alike; a null id counts as the empty text for its
fold; without training documents every token is unknown and has the uniform
probability; columns beside id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import (
    LOWER,
    crc_mod5,
    encoded,
    index_block,
    kept_in_worker,
    mix,
    packed_ints,
    packed_sorted,
    removed,
    task_block,
    texts,
    unpacked_ints,
    unpacked_sorted,
    word_hashes,
    written,
)

CLASS_BITS = 16
CLASSES = 1 << CLASS_BITS
STRENGTH = 1.0
#: Groups of more customers use an integral instead of a table of weights.
EXACT = 1_024
_DRAWN = 1 << 20
BURN_IN = 2
SAMPLES = 2
ROUNDS = 2
INDEX_BYTES = 8 << 20
LEAST_INDEX_BLOCKS = 32
BLOCK_TOKENS = 4_000_000

#: Hashes of the end of a text, and of what stands before its first word.
_END, _START = np.uint64(0x9D8A7B6C5E4F3021), np.uint64(0x1B2C3D4E5F607182)


def word_class(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - CLASS_BITS)).astype(np.int64)


# ---- seating --------------------------------------------------------------


def _table_rows(discount: float) -> np.ndarray:
    """Row c, column t: log of the summed weights of all seatings of c customers at t tables, for c up to ``EXACT``."""
    held = kept_in_worker("table_rows", dict)
    if discount not in held:
        if len(held) >= 4:  # two are in use at a time
            held.clear()
        rows = np.full((EXACT + 1, EXACT + 1), -np.inf)
        rows[0, 0] = 0.0
        number = np.arange(EXACT + 1)
        for c in range(EXACT):
            # the next customer opens a table or joins one
            with np.errstate(divide="ignore"):
                joins = rows[c] + np.log(np.maximum(c - discount * number, 0))
            joins[1:] = np.logaddexp(joins[1:], rows[c, :-1])
            joins[0] = -np.inf
            rows[c + 1] = joins
        held[discount] = rows
    return held[discount]


def _near_full(c: int, most: int, discount: float) -> np.ndarray:
    """Log weights of c customers at c, c - 1, ..., c - most tables."""
    out = np.full(most + 1, -np.inf)
    out[0] = 0.0
    less = np.arange(most + 1)
    for n in range(1, c):
        # with j tables less than customers: opened, or joined from j - 1
        with np.errstate(divide="ignore"):
            joined = out[:-1] + np.log(np.maximum(n - (n - less[:-1]) * discount, 0))
        out[1:] = np.logaddexp(out[1:], joined)
        out[n + 1 :] = -np.inf
    return out


def _large(c: int, t: np.ndarray, discount: float) -> np.ndarray:
    """Log weights of c customers at t tables, up to one constant, for many customers.

    The weights are c! / (t! discount^t) times the coefficient of z^c in
    (1 - (1 - z)^discount)^t.  This is Cauchy's integral along a parabola
    around the cut through the saddle point, by the trapezoid rule.
    """
    t = t.astype(np.float64)
    low, high = np.full(len(t), math.log(2 / (c + 1))), np.full(len(t), -1e-9)  # logs of the distance from 1
    for _ in range(24):
        middle = (low + high) / 2
        x = np.exp(middle)
        falls = t * discount * x ** (discount - 1) * (1 - x) > (c + 1) * -np.expm1(discount * middle)
        low, high = np.where(falls, middle, low), np.where(falls, high, middle)
    x = np.exp(low)
    y = x**discount
    bend = (c + 1) / (1 - x) ** 2 - t * discount * x ** (discount - 2) * (discount - 1 + y) / (1 - y) ** 2
    step = 0.14 / np.sqrt(np.maximum(bend * x * x, 1.0))
    u = 1 + 1j * step[:, None] * np.arange(52)
    path = x[:, None] * u * u
    log = t[:, None] * np.log(1 - path**discount) - (c + 1) * np.log(1 - path)
    top = log[:, 0].real
    turned = np.exp(log - top[:, None]) * u
    total = step * x * (turned.real.sum(axis=1) - turned[:, 0].real / 2)
    return top + np.log(np.maximum(total, 1e-300)) - _log_factorial(t) - t * math.log(discount)


def _log_factorial(t: np.ndarray) -> np.ndarray:
    n = t + 11.0
    series = (n - 0.5) * np.log(n) - n + 0.5 * math.log(2 * math.pi) + 1 / (12 * n) - 1 / (360 * n**3) + 1 / (1260 * n**5)
    for k in range(1, 11):
        series = series - np.log(t + k)
    return series


def _window(c: int, fresh: float, discount: float) -> tuple[int, int]:
    """Numbers of tables outside of which the chance is negligible."""
    low, high = -700.0, 0.0  # log of 1 - z where fresh * z / (1 - z)^(1 - discount) is the number of customers
    for _ in range(80):
        middle = (low + high) / 2
        if fresh * -math.expm1(middle) * math.exp((discount - 1) * middle) > c:
            low = middle
        else:
            high = middle
    mean = fresh / discount * -math.expm1(discount * low)
    wide = 9 * math.sqrt(mean) + 30
    return max(1, int(mean - wide)), min(c, int(mean + wide) + 1)


def seated(counts: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator, keep: int = 1, burn_in: int = 0) -> np.ndarray:
    """Tables of each group of customers: one row per kept sample.

    ``fresh`` is the weight of a new table.  The number of tables of a whole
    group is drawn from its distribution, in which Gibbs sweeps over customers
    end, so samples are independent and ``burn_in`` changes nothing.
    """
    out = np.minimum(counts, 1)[None, :].repeat(keep, axis=0)
    many = np.flatnonzero(counts > 1)
    many = many[np.argsort(counts[many], kind="stable")]
    if not len(many):
        return out
    sizes, first = np.unique(counts[many], return_index=True)
    for c, group in zip(sizes.tolist(), np.split(many, first[1:]), strict=True):
        if c <= EXACT:
            number = np.arange(1, c + 1)
            row = _table_rows(discount)[c, 1 : c + 1]
            for at in range(0, len(group), max(1, _DRAWN // c)):
                own = group[at : at + max(1, _DRAWN // c)]
                out[:, own] = _drawn(np.log(fresh[own])[:, None] * number + row, rng, keep) + 1
            continue
        for g in group.tolist():
            low, high = _window(c, float(fresh[g]), discount)
            number = np.arange(low, high + 1)
            if high > c - 64:
                row = _near_full(c, c - low, discount)[::-1][: len(number)]
            else:
                row = np.concatenate([_large(c, number[k : k + 4_096], discount) for k in range(0, len(number), 4_096)])
            out[:, g] = _drawn((math.log(fresh[g]) * number + row)[None, :], rng, keep)[:, 0] + low
    return out


def _drawn(logs: np.ndarray, rng: np.random.Generator, keep: int) -> np.ndarray:
    """A column for each row and sample, by the weights whose logs are given."""
    sums = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
    return np.stack([(sums <= rng.random(len(logs))[:, None] * sums[:, -1:]).sum(axis=1) for _ in range(keep)])


def cell_samples(cells: dict, model: dict, seed: int, keep: int, burn_in: int = BURN_IN) -> list[dict]:
    """Kept samples of an index block: tables per cell, customers and tables of its words at the parent.

    A sweep seats the pairs given the parent, then the parent given the pairs.
    It starts from the seating in ``cells`` or else from one table per pair.
    """
    rng = np.random.default_rng(seed)
    word, cls, count = cells["word"], cells["class"], cells["count"]
    n_words = cells["words"]
    uniform = 1.0 / (model["V"] + 1)
    root_fresh = np.full(n_words, (STRENGTH + model["root_discount"] * model["root_tables"]) * uniform)
    if "served" in cells:
        served, tops = cells["served"], cells["tops"]
    else:
        served = np.bincount(word, np.minimum(count, 1), n_words).astype(np.int64)
        tops = seated(served, root_fresh, model["root_discount"], rng)[0]
    out = []
    for sweep in range(burn_in + keep):
        p = _parent(served, tops, model["root_customers"], model["root_tables"], model["root_discount"], uniform)
        tables = seated(count, (STRENGTH + model["discount"] * model["tables"][cls]) * p[word], model["discount"], rng)[0]
        served = np.bincount(word, tables, n_words).astype(np.int64)
        tops = seated(served, root_fresh, model["root_discount"], rng)[0]
        if sweep >= burn_in:
            out.append({"tables": tables, "served": served, "tops": tops})
    return out


def _parent(served: np.ndarray, tops: np.ndarray, customers: float, tables: float, discount: float, uniform: float) -> np.ndarray:
    """Predictive probability of single words."""
    return (np.maximum(served - discount * tops, 0) + (STRENGTH + discount * tables) * uniform) / (STRENGTH + customers)


# ---- document blocks ------------------------------------------------------

_BLOCK = pa.schema([("block", pa.int64()), ("index", pa.int64()), *((c, pa.binary()) for c in ("ids", "held", "sizes", "words", "tokens", "scores", "counts"))])
_BLOCK_SQL = "block bigint, index bigint, ids binary, held binary, sizes binary, words binary, tokens binary, scores binary, counts binary"


def _row(schema: pa.Schema, **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([values], schema)


def _rows(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in parts:
        for k in range(batch.num_rows):
            yield {name: batch.column(name)[k].as_py() for name in batch.schema.names}


def _blocks(docs: DataFrame) -> DataFrame:
    """Documents as numbers: one row per block, with its words by hash."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = task_block() << 24, 0
        ids, held, tokens, total = [], [], [], 0

        def out() -> pa.RecordBatch:
            words, which = np.unique(np.concatenate(tokens), return_inverse=True)
            values = np.array([0 if i is None else i for i in ids], "<i8")
            return _row(
                _BLOCK,
                block=task + number,
                index=-1,
                ids=values.tobytes() + np.array([i is None for i in ids], np.uint8).tobytes(),
                held=np.array(held, np.uint8).tobytes(),
                sizes=packed_ints(np.array([len(t) for t in tokens])),
                words=packed_sorted(words),
                tokens=packed_ints(which),
            )

        for batch in parts:
            for doc, out_of, text in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), texts(batch, "text"), strict=True):
                ids.append(doc)
                held.append(bool(out_of))
                tokens.append(np.append(word_hashes(encoded(text).translate(LOWER)), _END))
                total += len(tokens[-1])
                if total >= BLOCK_TOKENS:
                    yield out()
                    number, total = number + 1, 0
                    for x in (ids, held, tokens):
                        x.clear()
        if ids:
            yield out()

    return docs.mapInArrow(run, _BLOCK_SQL)


def _opened(row: dict) -> dict:
    """A document block with its (word, class) code for each token."""
    words = unpacked_sorted(row["words"])
    sizes = unpacked_ints(row["sizes"]).astype(np.int64)
    tokens = unpacked_ints(row["tokens"]).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    classes = word_class(words)
    before = np.empty(len(tokens), np.int64)
    before[1:] = classes[tokens[:-1]]
    before[starts] = word_class(np.array([_START]))[0]
    held = np.frombuffer(row["held"], np.uint8)
    return {"words": words, "sizes": sizes, "starts": starts, "tokens": tokens, "codes": (tokens << CLASS_BITS) | before, "held": held, "train": np.repeat(1 - held.astype(np.int64), sizes)}


_ASK = pa.schema([("index", pa.int64()), ("block", pa.int64()), *((c, pa.binary()) for c in ("words", "pairs", "classes", "counts"))])


def _asked(blocks: DataFrame, index_blocks: int) -> DataFrame:
    """What each document block tells each index block: its pairs and their training counts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(parts):
            b = _opened(row)
            marked = np.sort((b["codes"] << 1) | b["train"])
            codes = marked >> 1
            first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
            counts = np.add.reduceat(marked & 1, first)
            codes = codes[first]
            word, cls = codes >> CLASS_BITS, codes & (CLASSES - 1)
            pairs = np.bincount(word, minlength=len(b["words"]))
            owner = index_block(b["words"], index_blocks)
            cuts = np.searchsorted(owner, np.arange(index_blocks + 1))
            ends = np.concatenate(([0], np.cumsum(pairs)))
            for k in range(index_blocks):
                x, y = cuts[k], cuts[k + 1]
                if x < y:
                    p, q = ends[x], ends[y]
                    yield _row(
                        _ASK,
                        index=k,
                        block=row["block"],
                        words=packed_sorted(b["words"][x:y]),
                        pairs=packed_ints(pairs[x:y]),
                        classes=packed_ints(cls[p:q]),
                        counts=packed_ints(counts[p:q]),
                    )

    return blocks.select("block", "held", "sizes", "words", "tokens").mapInArrow(run, "index bigint, block bigint, words binary, pairs binary, classes binary, counts binary")


# ---- index blocks ---------------------------------------------------------

_SHARD = pa.schema(
    [("index", pa.int64()), ("n_tokens", pa.int64()), ("n_words", pa.int64()), ("n_pairs", pa.int64()), ("once", pa.int64()), ("twice", pa.int64()), ("word_once", pa.int64()), ("word_twice", pa.int64())]
    + [("codes", pa.binary()), ("counts", pa.binary()), ("word_counts", pa.binary()), ("blocks", pa.list_(pa.int64())), ("wanted", pa.list_(pa.binary()))]
)
_SHARD_SQL = "index bigint, n_tokens bigint, n_words bigint, n_pairs bigint, once bigint, twice bigint, word_once bigint, word_twice bigint, codes binary, counts binary, word_counts binary, blocks array<bigint>, wanted array<binary>"


def _shards(asked: DataFrame, index_blocks: int) -> DataFrame:
    """Index blocks: merged counts, and which of the pairs each document block asked for."""

    def merged(index: int, rows: list[dict]) -> pa.RecordBatch:
        words = [unpacked_sorted(r["words"]) for r in rows]
        every = np.unique(np.concatenate(words))
        codes, counts = [], []
        for r, own in zip(rows, words, strict=True):
            word = np.repeat(np.searchsorted(every, own), unpacked_ints(r["pairs"]).astype(np.int64))
            codes.append((word << CLASS_BITS) | unpacked_ints(r["classes"]).astype(np.int64))
            counts.append(unpacked_ints(r["counts"]).astype(np.int64))
        cells, which = np.unique(np.concatenate(codes), return_inverse=True)
        count = np.bincount(which, np.concatenate(counts), len(cells)).astype(np.int64)
        by_word = np.bincount(cells >> CLASS_BITS, count, len(every)).astype(np.int64)
        kinds = np.bincount((cells >> CLASS_BITS)[count > 0], minlength=len(every))
        ends = np.cumsum([0, *map(len, codes)])
        return _row(
            _SHARD,
            index=index,
            n_tokens=int(count.sum()),
            n_words=int((by_word > 0).sum()),
            n_pairs=int((count > 0).sum()),
            once=int((count == 1).sum()),
            twice=int((count == 2).sum()),
            word_once=int((kinds == 1).sum()),
            word_twice=int((kinds == 2).sum()),
            codes=packed_sorted(cells.astype(np.uint64)),
            counts=packed_ints(count),
            word_counts=packed_ints(by_word),
            blocks=[r["block"] for r in rows],
            wanted=[packed_sorted(which[a:b].astype(np.uint64)) for a, b in zip(ends, ends[1:], strict=False)],
        )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in _rows(parts):
            if held and held[0]["index"] != row["index"]:
                yield merged(held[0]["index"], held)
                held = []
            held.append(row)
        if held:
            yield merged(held[0]["index"], held)

    # seating takes more time than its few bytes suggest: tasks by number of index blocks, not by size
    dealt = asked.repartition(max(LEAST_INDEX_BLOCKS, index_blocks // 4), "index")
    return dealt.sortWithinPartitions("index", "block").mapInArrow(run, _SHARD_SQL)


def _cells(row: dict) -> dict:
    codes = unpacked_sorted(row["codes"]).astype(np.int64)
    word_counts = unpacked_ints(row["word_counts"]).astype(np.int64)
    return {"word": codes >> CLASS_BITS, "class": codes & (CLASSES - 1), "count": unpacked_ints(row["counts"]).astype(np.int64), "words": len(word_counts), "word_counts": word_counts}


_CHUNK = 4_096


def _sampled(shards: DataFrame, model, seed: int, keep: int) -> DataFrame:
    """The index blocks with their kept samples, packed one after the other; seating goes on from the last of those they have."""
    kept = ("tables", "served", "tops")
    bare = [c for c in shards.columns if c not in kept]
    fields = [f for f in _SHARD if f.name in bare]
    schema = pa.schema([*fields, *((c, pa.list_(pa.binary())) for c in kept)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(parts):
            cells = _cells(row)
            if "served" in row:
                cells |= {c: unpacked_ints(row[c][-1]).astype(np.int64) for c in ("served", "tops")}
            samples = cell_samples(cells, model.value, [seed, row["index"]], keep)
            yield _row(schema, **{c: row[c] for c in bare}, **{c: [packed_ints(s[c]) for s in samples] for c in kept})

    kinds = {f.name: f.dataType.simpleString() for f in shards.schema.fields if f.name in bare}
    return shards.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", tables array<binary>, served array<binary>, tops array<binary>")


def _totals(shards: DataFrame, keep: int) -> list[dict]:
    """Totals over all index blocks for each kept sample: tables of each class, customers and tables of the parent.

    Without samples: one table per pair, and the customers of each class.
    """
    bare = "tables" not in shards.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((keep, CLASSES + 2), np.int64)
        for row in _rows(parts):
            cells = _cells(row)
            if bare:
                sums[0, :CLASSES] += np.bincount(cells["class"], cells["count"] > 0, CLASSES).astype(np.int64)
                sums[1, :CLASSES] += np.bincount(cells["class"], cells["count"], CLASSES).astype(np.int64)
            else:
                for s in range(keep):
                    tables, served, tops = (unpacked_ints(row[c][s]).astype(np.int64) for c in ("tables", "served", "tops"))
                    sums[s, :CLASSES] += np.bincount(cells["class"], tables, CLASSES).astype(np.int64)
                    sums[s, CLASSES:] += [int(served.sum()), int(tops.sum())]
        flat = sums.ravel()
        for at in range(0, len(flat), _CHUNK):
            yield _row(_PART, chunk=at // _CHUNK, body=packed_ints(flat[at : at + _CHUNK]))

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for row in _rows(parts):
            own = unpacked_ints(row["body"])
            sums[row["chunk"]] = sums[row["chunk"]] + own if row["chunk"] in sums else own
        for chunk, body in sums.items():
            yield _row(_PART, chunk=chunk, body=packed_ints(body))

    kind = "chunk bigint, body binary"
    # a fixed number of totals, whatever the corpus
    needed = ["codes", "counts", "word_counts", *([] if bare else ["tables", "served", "tops"])]
    rows = shards.select(*needed).mapInArrow(run, kind).repartition("chunk").mapInArrow(add, kind).collect()
    flat = np.zeros(keep * (CLASSES + 2), np.float64)
    for r in rows:
        flat[r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] = unpacked_ints(bytes(r.body))
    return [{"tables": s[:CLASSES], "root_customers": float(s[CLASSES]), "root_tables": float(s[CLASSES + 1])} for s in flat.reshape(keep, -1)]


_PART = pa.schema([("chunk", pa.int64()), ("body", pa.binary())])


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def fit(shards: DataFrame, rounds: int = ROUNDS, keep: int = SAMPLES, path: str | None = None) -> tuple[dict, list[dict], DataFrame]:
    """State of the restaurants before the last round, the exact totals of its kept samples, and the samples.

    Each round goes on from the seating of the one before.  The index blocks at
    ``path`` are removed once the first round holds all of them.
    """
    spark = shards.sparkSession
    sc = spark.sparkContext
    sums = shards.agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_words", "n_pairs", "once", "twice", "word_once", "word_twice")]).first().asDict()
    n = {k: int(v or 0) for k, v in sums.items()}
    tables, customers = _totals(shards, 2)
    model = {
        "N": n["n_tokens"],
        "V": n["n_words"],
        "discount": _discount(n["once"], n["twice"]),
        "root_discount": _discount(n["word_once"], n["word_twice"]),
        "tables": tables["tables"],
        "customers": customers["tables"],
        "root_customers": float(n["n_pairs"]),
        "root_tables": float(n["n_words"]),
    }
    for turn in range(rounds + 1):
        last = turn == rounds
        shards, after = written(_sampled(shards, sc.broadcast(dict(model)), turn + 1, keep if last else 1), "samples")
        if path:
            removed(spark, path)
        path = after
        totals = _totals(shards, keep if last else 1)
        if not last:
            model |= totals[0]
    return model, totals, shards


def _answers(samples: DataFrame, model, totals: list[dict]) -> DataFrame:
    """Average log10 probability of each pair that a document block asked for, and the counts of its words."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value
        uniform = 1.0 / (held["V"] + 1)
        for row in _rows(parts):
            cells = _cells(row)
            room = STRENGTH + held["customers"][cells["class"]]
            p = np.zeros(len(room))
            for s, total in enumerate(totals):
                tables, served, tops = (unpacked_ints(row[c][s]).astype(np.int64) for c in ("tables", "served", "tops"))
                parent = _parent(served, tops, total["root_customers"], total["root_tables"], held["root_discount"], uniform)
                back = STRENGTH + held["discount"] * total["tables"][cells["class"]]
                p += (np.maximum(cells["count"] - held["discount"] * tables, 0) + back * parent[cells["word"]]) / room
            score = np.log10(p / len(totals)).astype("<f4")
            for block, body in zip(row["blocks"], row["wanted"], strict=True):
                at = unpacked_sorted(body).astype(np.int64)
                word = cells["word"][at]
                own = word[np.concatenate(([True], word[1:] != word[:-1]))]
                yield _row(_BLOCK, block=block, index=row["index"], scores=score[at].tobytes(), counts=packed_ints(cells["word_counts"][own]))

    needed = ["index", "codes", "counts", "word_counts", "blocks", "wanted", "tables", "served", "tops"]
    return samples.select(*needed).mapInArrow(run, _BLOCK_SQL)


def _documents(blocks: DataFrame, answers: DataFrame, n: int, v: int) -> DataFrame:
    """Scores of the documents of each block from the answers of all index blocks."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])

    def scored(rows: list[dict]) -> pa.RecordBatch:
        row, *got = rows
        b = _opened(row)
        codes, which = np.unique(b["codes"], return_inverse=True)
        score = np.frombuffer(b"".join(r["scores"] for r in got), "<f4").astype(np.float64)[which]
        count = np.concatenate([unpacked_ints(r["counts"]) for r in got]).astype(np.float64)[b["tokens"]]
        base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
        docs = len(b["sizes"])
        ids = np.frombuffer(row["ids"], "<i8", docs)
        none = np.frombuffer(row["ids"], np.uint8, docs, 8 * docs).astype(bool)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, mask=none),
                pa.array(b["held"].astype(bool)),
                pa.array(b["sizes"]),
                pa.array(np.add.reduceat((count > 0).astype(np.int64), b["starts"])),
                pa.array(np.full(docs, n, np.int64)),
                pa.array(np.add.reduceat(base, b["starts"])),
                pa.array(np.add.reduceat(score, b["starts"])),
            ],
            schema=schema,
        )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in _rows(parts):
            if held and held[0]["block"] != row["block"]:
                yield scored(held)
                held = []
            held.append(row)
        if held:
            yield scored(held)

    dealt = blocks.unionByName(answers).repartition("block").sortWithinPartitions("block", "index")
    return dealt.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def score(docs: DataFrame, rounds: int = ROUNDS, keep: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """log10 probability of each text under the model of the documents outside the held-out fold, and a baseline."""
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (crc_mod5(F.col(id_col)) == 1).alias("held"), F.col(text_col).cast("string").alias("text"))
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    index_blocks = max(LEAST_INDEX_BLOCKS, -(-size // INDEX_BYTES))
    blocks, _ = written(_blocks(chosen), "blocks")
    shards, path = written(_shards(_asked(blocks, index_blocks), index_blocks), "shards")
    model, totals, samples = fit(shards, rounds, keep, path)
    return _documents(blocks, _answers(samples, spark.sparkContext.broadcast(model), totals), model["N"], model["V"])


def perplexity(scored: DataFrame) -> DataFrame:
    """Per-token perplexity of the model and of the baseline, by fold."""
    def of(c: str):
        return F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))

    return scored.groupBy("held_out").agg(of("score").alias("model"), of("base_score").alias("baseline"))
