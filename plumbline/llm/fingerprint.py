"""Document fingerprints by randomised edit embedding.

Several shared random walks go over the characters of a text.  A walk repeats a
character for as many steps as random bits of (step, character) say and goes on
to the next; it depends on nothing else, so after an edit the walks of two texts
soon fall into step again, and texts at a small edit distance become sequences
at a small Hamming distance.

A fingerprint samples the walks: steps are cut into octaves (2^k steps each), and
from every octave each walk gives the same few random steps, one hexadecimal
digit hashed from the character there, ``.`` behind the end.  Equal beginnings give
equal digits whatever the lengths, and weighing an octave by its steps makes the
share of equal digits an estimate of the share of equal steps.  The digits of one walk
and octave are a band; texts that share bands are candidates, verified by all
digits (``linked``).

Walks of many texts advance together, one character a step.  Texts come in the
order of their ids, so that each meets the next one in its task; only the first
and last texts of a task's range are moved again, to meet each other.

Defined results: null is the empty text, whose fingerprint is empty; ids follow each
other in ascending order, null first, equal ids by the hash of their text; the last is followed by
the first, a single document by itself; repeated rows each count; columns beside
id and text are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import kept_in_worker, mix, task_block, texts, written

WALKS, OCTAVES, DIGITS = 4, 48, 8
#: Random bits repeat after so many steps, and characters fall into so many classes of equal bits.
PERIOD, CLASSES = 4_096, 64
#: Characters of the texts that walk together, and the number of walks from which on they do.
LOT_CHARS, TOGETHER = 1_000_000, 64
#: A digit of unlike characters is equal by chance so often.
CHANCE = 1 / 16
_END = ord(".")
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


class Walks:
    """The shared random bits and samples; the same in every task."""

    def __init__(self, seed: int = 20_240):
        rng = np.random.default_rng(seed)
        bits = rng.random((WALKS, CLASSES, PERIOD)) < 0.5
        bits[:, :, -1] = True
        steps = np.full((WALKS, CLASSES, PERIOD), PERIOD, np.int64)
        ahead = np.zeros((WALKS, CLASSES), np.int64)
        for at in [*range(PERIOD - 1, -1, -1)] * 2:  # twice, for the bits that lie behind the end of the period
            ahead = np.where(bits[:, :, at], 1, ahead + 1)
            steps[:, :, at] = ahead
        self.stays = steps.astype(np.uint8).ravel()
        self.rows = [row.tobytes() for row in steps.astype(np.uint8).reshape(-1, PERIOD)]
        self.per = [min(1 << k, DIGITS) for k in range(OCTAVES)]
        self.sizes = np.cumsum([0, *(WALKS * n for n in self.per)])
        self.samples, self.slots = [], []
        for w in range(WALKS):
            own = [np.sort((1 << k) - 1 + (np.arange(n) if n == 1 << k else rng.choice(1 << k, n, replace=False) if k < 20 else rng.integers(0, 1 << k, n))) for k, n in enumerate(self.per)]
            self.samples.append(np.concatenate(own))
            self.slots.append(np.concatenate([self.sizes[k] + w * n + np.arange(n) for k, n in enumerate(self.per)]))
        self.salts = [mix(np.arange(len(s), dtype=np.uint64) + np.uint64(1000 * (w + 1))) for w, s in enumerate(self.samples)]
        self.weights = np.concatenate([np.full(WALKS * n, (1 << k) / (WALKS * n)) for k, n in enumerate(self.per)])

    def go(self, classes: np.ndarray, start: np.ndarray, length: np.ndarray, walk: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Steps at which each character begins, for many stretches; where each stretch begins there, and the step after it."""
        first = np.cumsum(length) - length
        trace = np.empty(int(length.sum()), np.int64)
        order = np.argsort(-length, kind="stable")
        lengths = length[order]
        place, out, step = start[order].copy(), first[order].copy(), at[order].copy()
        base = walk[order] * (CLASSES * PERIOD)
        done, live = 0, int(np.searchsorted(-lengths, 0))
        while live >= TOGETHER:
            # All of the shortest live stretch, and then on with the others.
            for _ in range(int(lengths[live - 1]) - done):
                now = step[:live]
                trace[out[:live]] = now
                now += self.stays[base[:live] + classes[place[:live]] + (now & (PERIOD - 1))]
                place[:live] += 1
                out[:live] += 1
            done = int(lengths[live - 1])
            live = int(np.searchsorted(-lengths, -done))
        for k in range(live):
            now, rows, mask = int(step[k]), self.rows, PERIOD - 1
            own = (classes[place[k] : place[k] + lengths[k] - done] // PERIOD + int(base[k]) // PERIOD).tolist()
            steps = []
            for c in own:
                steps.append(now)
                now += rows[c][now & mask]
            trace[out[k] : out[k] + len(steps)] = steps
            step[k] = now
        end = np.empty_like(step)
        end[order] = step
        return trace, first, end

    def digits(self, w: int, codes: np.ndarray, trace: np.ndarray, since: int, end: int, into: np.ndarray) -> None:
        """The digits of walk ``w`` at its samples from step ``since`` to ``end``, put into a fingerprint."""
        low, high = np.searchsorted(self.samples[w], (since, end))
        at = np.searchsorted(trace, self.samples[w][low:high], "right") - 1
        into[self.slots[w][low:high]] = _HEX[mix(codes[at].astype(np.uint64) + self.salts[w][low:high]) >> np.uint64(60)]

    def blank(self, end: int) -> np.ndarray:
        """A fingerprint without digits for walks of ``end`` steps."""
        return np.full(self.sizes[(end).bit_length()], _END, np.uint8)

    def likeness(self, a: np.ndarray, b: np.ndarray) -> float:
        """Estimated share of equal steps: 0 for unlike texts, 1 for equal ones."""
        if len(a) == len(b) and (a == b).all():
            return 1.0
        n = max(len(a), len(b))
        a, b = (np.append(x, np.full(n - len(x), _END, np.uint8)) for x in (a, b))
        there = ((a != _END) | (b != _END)) * self.weights[:n]
        equal = float(there[a == b].sum() / there.sum())
        return max(0.0, (equal - CHANCE) / (1 - CHANCE))


def _walks() -> Walks:
    return kept_in_worker("edit walks", Walks)


def _lot(docs: list[tuple], nexts: list[str]) -> Iterator[tuple]:
    """Result rows of documents (id, text) and the texts that follow them."""
    w, lanes = _walks(), np.arange(WALKS)
    every = [t for _, t in docs] + [nexts[-1]]
    codes = np.frombuffer("".join(every).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.array([len(t) for t in every])
    start = np.cumsum(size) - size
    classes = (mix(codes) >> np.uint64(58)).astype(np.int64) * PERIOD

    def go(begin: np.ndarray, length: np.ndarray, at: np.ndarray):
        m = len(begin)
        return w.go(classes, np.repeat(begin, WALKS), np.repeat(length, WALKS), np.tile(lanes, m), at)

    trace, first, end = go(start, size, np.zeros(len(every) * WALKS, np.int64))
    prints = []
    for k in range(len(every)):
        own = w.blank(int(end[k * WALKS : (k + 1) * WALKS].max()))
        for lane in range(WALKS):
            i = k * WALKS + lane
            w.digits(lane, codes[start[k] : start[k] + size[k]], trace[first[i] : first[i] + size[k]], 0, int(end[i]), own)
        prints.append(own)
    # Edited texts go on from the step that their own walk has reached.
    kept = size[:-1] - size[:-1] // 2
    taken = np.minimum(size[:-1] // 2, size[1:])
    lane_first = first[: len(docs) * WALKS]
    cut = np.repeat(kept, WALKS)
    inside = cut < np.repeat(size[:-1], WALKS)
    begin = np.where(inside, trace[np.minimum(lane_first + cut, max(0, len(trace) - 1))] if len(trace) else 0, end[: len(docs) * WALKS])
    more, more_first, more_end = go(start[1:], taken, begin)
    for k, (doc_id, text) in enumerate(docs):
        new = w.blank(int(more_end[k * WALKS : (k + 1) * WALKS].max()))
        old = prints[k][: len(new)]
        for lane in range(WALKS):
            i = k * WALKS + lane
            known = np.searchsorted(w.samples[lane], begin[i])
            new[w.slots[lane][:known]] = old[w.slots[lane][:known]]
            w.digits(lane, codes[start[k + 1] : start[k + 1] + taken[k]], more[more_first[i] : more_first[i] + taken[k]], int(begin[i]), int(more_end[i]), new)
        edited = text[: kept[k]] + every[k + 1][: taken[k]]
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        yield doc_id, int(size[k]), digest, prints[k].tobytes().decode(), new.tobytes().decode(), w.likeness(prints[k], new), w.likeness(prints[k], prints[k + 1])


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_SCHEMA = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _arrays(rows: list[tuple], id_type: pa.DataType) -> list[pa.Array]:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_NAMES)
    return [pa.array(c, kind) for c, kind in zip(columns, [id_type, *_KINDS], strict=True)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lot_chars: int = LOT_CHARS) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and the likeness to this and to the next document."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    ranged = own.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, id_type, first, held, chars = task_block(), None, True, [], 0

        def out(rows: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
            """Rows; (row or None, edge, text) of the first and the last document."""
            marks = [0] * len(rows), [None] * len(rows)
            for doc, edge, edge_text in edges:
                rows = [*rows, doc]
                marks[0].append(edge)
                marks[1].append(edge_text)
            arrays = [*_arrays(rows, id_type), pa.array([part] * len(rows), pa.int64()), pa.array(marks[0], pa.int32()), pa.array(marks[1], pa.string())]
            return pa.RecordBatch.from_arrays(arrays, [*_NAMES, "part", "edge", "edge_text"])

        nothing = (None,) * 6
        for batch in parts:
            id_type = batch.column(0).type
            for at in range(0, batch.num_rows, 64):
                few = batch.slice(at, 64)
                for doc_id, value in zip(few.column(0).to_pylist(), texts(few, "text"), strict=True):
                    if first:
                        yield out([], [((doc_id, *nothing), 1, value)])
                        first = False
                    held.append((doc_id, value))
                    chars += len(value)
                    if chars >= lot_chars and len(held) > 1:
                        yield out(list(_lot(held[:-1], [t for _, t in held[1:]])), [])
                        held, chars = held[-1:], len(value)
        if held:
            rows = list(_lot(held[:-1], [t for _, t in held[1:]])) if len(held) > 1 else []
            yield out(rows, [((held[-1][0], *nothing), 2, held[-1][1])])

    def last_ones(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            rows = [row for d, t, n in zip(*(c.to_pylist() for c in batch.columns), strict=True) for row in _lot([(d, t)], [n])]
            yield pa.RecordBatch.from_arrays(_arrays(rows, batch.column(0).type), _NAMES)

    held, _ = written(ranged.mapInArrow(run, f"doc_id {kind}, {_SCHEMA}, part bigint, edge int, edge_text string"), "fingerprints")
    heads = held.where("edge = 1").select(F.col("part").alias("next_part"), F.col("edge_text").alias("next_text"))
    tails = held.where("edge = 2").select("part", "doc_id", "edge_text")
    # One number per task: which task's range follows.
    order = held.where("edge = 1").select("part").withColumn("next_part", F.lead("part").over(Window.orderBy("part")))
    order = order.withColumn("next_part", F.coalesce("next_part", F.min("part").over(Window.partitionBy())))
    meeting = tails.join(order, "part").join(heads, "next_part").select("doc_id", "edge_text", "next_text")
    return held.where("edge = 0").select(*_NAMES).unionAll(meeting.mapInArrow(last_ones, f"doc_id {kind}, {_SCHEMA}"))


def bands(fingerprint: str, least: int = 5) -> list[str]:
    """Band keys: octave, walk and digits, of full bands from octave ``least`` on, or of all in a shorter text."""
    w, out = _walks(), []
    top = int(np.searchsorted(w.sizes, len(fingerprint)))
    for k in range(min(least, max(0, top - 1)), top):
        for lane in range(WALKS):
            at = int(w.sizes[k]) + lane * w.per[k]
            own = fingerprint[at : at + w.per[k]]
            if "." not in own:
                out.append(f"{k} {lane} {own}")
    return out


def linked(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, first_id, likeness): each document with the smallest id of each of its bands, where all digits verify it.

    A band of any size gives one link for each of its documents, so no pairs are
    formed within a band.  Equal fingerprints meet once, by their smallest id.
    """

    @F.pandas_udf("array<string>")
    def band_keys(values):
        return values.map(bands)

    @F.pandas_udf("double")
    def alike(a, b):
        w = _walks()
        both = zip(a, b, strict=True)
        return a.__class__([w.likeness(np.frombuffer(x.encode(), np.uint8), np.frombuffer(y.encode(), np.uint8)) for x, y in both], dtype="float64")

    own = prints.where("fingerprint != ''").select("doc_id", "fingerprint")
    classes = own.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    banded, _ = written(classes.select("first_id", "fingerprint", F.explode(band_keys("fingerprint")).alias("band")), "bands")
    heads = banded.groupBy("band").agg(F.min_by("fingerprint", "first_id").alias("head"), F.min("first_id").alias("head_id"))
    near = banded.join(heads, "band").where("first_id > head_id").select("fingerprint", "head", "head_id").distinct()
    near = near.withColumn("likeness", alike("fingerprint", "head")).where(F.col("likeness") >= least)
    unlike = own.join(near, "fingerprint").select("doc_id", F.col("head_id").alias("first_id"), "likeness")
    equal = own.join(classes, "fingerprint").where("doc_id > first_id").select("doc_id", "first_id", F.lit(1.0).alias("likeness"))
    return unlike.unionAll(equal)
