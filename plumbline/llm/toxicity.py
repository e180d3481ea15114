"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and word beginnings (four to six bytes), lower-cased.  All terms
of the examples have weight: a dampened count times the inverse document
frequency, times a factor that rises from ``FLOOR`` to one with the lower Wilson
bound of the share of toxic texts among those that hold the term.  A term that
no example has counts in the length of a text like one of a single example.

Examples are a bounded sample of labelled rows, half of it (``sample`` / 2) from
each class where there are more, so rare toxic texts are not crowded out; each
stands for as many rows as its class was thinned by, in frequencies and rates.
Near copies of one class (equal min-hash, and at least 0.8 of the five-word
shingles shared) count once.  At most ``entries`` terms of examples are kept,
by dropping whole examples in the order of a hash.

The index sorts examples into blocks of ``BLOCK`` and keeps, for each term and
block, the largest weight and where its postings begin.  A query adds these up
to a bound per block, on top of the part that the commonest terms give, and opens
the blocks of the best bounds, then all whose bound is no less than the k-th best
similarity: the neighbours are exact.  A
neighbour's vote counts as one over its distance.  An isotonic map fitted on
leave-one-out votes makes the score a rate; it runs on to one at a vote of one,
which a text has that equals a toxic example.  The ids and similarities of the
nearest neighbours are the evidence.

Defined results: a null or empty text has no neighbours and gets the rate of a
vote without any; ties go to the smaller example id; a labelled id that is given
twice is toxic if any row says so, and one with several texts counts with one of
them; rows of ``labels`` with a null are not used; without toxic examples each
score is the smoothed rate; columns beside those named are ignored, whatever
their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WORD_BYTES, crc_mod5, encoded, kept_in_worker, packed_ints, range_hashes, rolling, slices, texts, unpacked_ints, word_places, written

SAMPLE = 4_096
#: Terms of all examples together, with a weight each.
ENTRIES = 4_000_000
NEIGHBOURS = 15
BLOCK = 512
Z = 2.5
#: Weight of a term that tells nothing, beside one that tells all.
FLOOR = 0.2
#: Added to distances, so that a copy counts as 100 neighbours without any likeness.
NEAR = 0.01
ALIKE = 0.8
#: Terms kept as columns: so many at most, each in one of ``COMMON_SHARE`` examples or more.
COMMON = 1_024
COMMON_SHARE = 64
#: Blocks opened at first, and texts compared at a time.
FIRST = 2
TOGETHER = 64
TOGETHER_BYTES = 1 << 17
PREFIXES = (4, 5, 6)


def bags(some: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words and word beginnings of each text, with their counts; short texts are cut together."""
    held: list[bytes] = []
    for text in some:
        held.append(encoded(text).translate(WORD_BYTES))
        if sum(map(len, held)) >= TOGETHER_BYTES:
            yield from _bags_of(held)
            held = []
    yield from _bags_of(held)


def _bags_of(held: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data = b" ".join(held)
    blank = np.zeros(256, bool)
    blank[32] = True
    starts, ends = word_places(data, blank)
    after = np.cumsum([len(t) + 1 for t in held])
    parts = [(range_hashes(data, starts, ends), np.searchsorted(starts, after))]
    for k in PREFIXES:
        long = ends - starts > k
        own = starts[long]
        # a beginning and a word of the same letters are different terms
        parts.append((range_hashes(data, own, own + k) + np.uint64(k), np.searchsorted(own, after)))
    for n in range(len(held)):
        yield np.unique(np.concatenate([h[to[n - 1] if n else 0 : to[n]] for h, to in parts]), return_counts=True)


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes of five consecutive words (of all words, if fewer), rising."""
    data = encoded(text).translate(WORD_BYTES)
    blank = np.zeros(256, bool)
    blank[32] = True
    words = range_hashes(data, *word_places(data, blank))
    return np.unique(rolling(words, min(5, len(words)))) if len(words) else words


def held_out(doc_id: Column) -> Column:
    return crc_mod5(doc_id) == 0


def _examples(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, toxic, terms, counts) of distinct labelled texts outside the held-out fold; rows per example of a class."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    # a class may use what the other one leaves of its half
    wanted = {c: min(n, sample - min(sizes.get(1 - c, 0), sample // 2)) for c, n in sizes.items()}
    share = {c: wanted[c] / n for c, n in sizes.items()}
    # ids are distinct here, so the hash alone bounds the rows: about `sample` of them
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000_000))
    limit = F.when(F.col("toxic") == 1, int(share.get(1, 0) * 1e9)).otherwise(int(share.get(0, 0) * 1e9))
    chosen = F.broadcast(known.where(draw < limit))
    texts_ = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    texts_ = texts_.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            signs = [shingles(text).view(np.int64) for text in texts(batch, "text")]
            held = list(bags(texts(batch, "text")))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("toxic"),
                    pa.array([int(s.view(np.uint64).min() >> np.uint64(1)) if len(s) else -1 for s in signs], pa.int64()),
                    pa.array(signs, pa.list_(pa.int64())),
                    pa.array([t.astype("<u8").tobytes() for t, _ in held], pa.binary()),
                    pa.array([n.astype("<u4").tobytes() for _, n in held], pa.binary()),
                ],
                ["doc_id", "toxic", "sign", "shingles", "terms", "counts"],
            )

    rows, _ = written(texts_.mapInArrow(cut, "doc_id bigint, toxic int, sign bigint, shingles array<bigint>, terms binary, counts binary"), "labelled")
    first = rows.groupBy("sign", "toxic").agg(F.min("doc_id").alias("first"), F.min_by("shingles", "doc_id").alias("other"))
    both = F.size(F.array_intersect("shingles", "other"))
    alike = both >= ALIKE * (F.size("shingles") + F.size("other") - both)
    one = rows.join(first, ["sign", "toxic"]).where((F.col("doc_id") == F.col("first")) | ~alike)
    return one.select("doc_id", "toxic", "terms", "counts"), {c: 1 / s for c, s in share.items()}


def _wilson(p: np.ndarray, n: np.ndarray, z: float) -> np.ndarray:
    """Lower bound of a share ``p`` seen in ``n`` cases."""
    return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after the other, and how many each has."""
    sizes = last - first
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0), sizes


class Index:
    """Block-max inverted index of example vectors (rows of term numbers and weights).

    The ``COMMON`` terms that stand in most examples are columns of a matrix: their part of
    all similarities is one product for many queries.  All other terms have postings.
    """

    def __init__(self, ids: list[int], labels: list[int], vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        # examples with the same strongest term share blocks, which keeps bounds tight
        order = sorted(range(len(ids)), key=lambda k: (int(vectors[k][0][vectors[k][1].argmax()]), ids[k]))
        self.ids = np.array([ids[k] for k in order], np.int64)
        self.labels = np.array([labels[k] for k in order], np.float64)
        self.edges = np.arange(0, len(order), BLOCK)
        names = np.concatenate([vectors[k][0] for k in order])
        place = np.repeat(np.arange(len(order)), [len(vectors[k][0]) for k in order])
        weight = np.concatenate([vectors[k][1] for k in order])
        held = np.bincount(names, minlength=n_terms)
        common = np.argsort(-held, kind="stable")[:COMMON]
        common = common[held[common] * COMMON_SHARE >= len(order)]
        self.column = np.full(n_terms, -1, np.int32)
        self.column[common] = np.arange(len(common))
        often = self.column[names] >= 0
        self.dense = np.zeros((len(common), len(order)))
        self.dense[self.column[names[often]], place[often]] = weight[often]
        names, place, weight = names[~often], place[~often], weight[~often]
        # places rise already, so a stable sort by term leaves them rising within a term
        by_term = np.argsort(names, kind="stable")
        names, self.place, self.weight = names[by_term], place[by_term].astype(np.int32), weight[by_term]
        block = self.place // BLOCK
        new = np.ones(len(names), bool)
        new[1:] = (names[1:] != names[:-1]) | (block[1:] != block[:-1])
        start = np.flatnonzero(new)
        self.start, self.block = np.append(start, len(names)), block[start]
        self.most = np.maximum.reduceat(self.weight, start) if len(start) else self.weight
        self.entry = np.searchsorted(names[start], np.arange(n_terms + 1))

    def nearest(self, names: np.ndarray, weights: np.ndarray, k: int, but: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and similarities of the k most similar examples, without those of similarity 0."""
        return next(self.nearest_each([(names, weights)], k, None if but is None else [but]))

    def nearest_each(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, but: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for each of several queries; ``but`` holds an id for each that is left out."""
        rows = np.zeros((len(queries), len(self.dense)))
        for row, (names, weights) in zip(rows, queries, strict=True):
            often = self.column[names]
            row[often[often >= 0]] = weights[often >= 0]
        known = rows @ self.dense
        for number, (names, weights) in enumerate(queries):
            rare = self.column[names] < 0
            score = known[number]
            if but is not None:  # below any sum that its other terms may reach
                score[self.ids == but[number]] = -2.0
            yield self._best(names[rare], weights[rare], score, k)

    def _best(self, names: np.ndarray, weights: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        entries, sizes = _ranges(self.entry[names], self.entry[names + 1])
        own, block = np.repeat(weights, sizes), self.block.take(entries, mode="clip")
        # no example of a block has more than the best common part and the largest weights together
        bound = np.maximum.reduceat(score, self.edges) + np.bincount(block, own * self.most.take(entries, mode="clip"), len(self.edges))
        left, seen = np.argsort(-bound, kind="stable"), np.zeros(len(score), bool)
        floor, step = 0.0, FIRST
        while True:
            # equal similarities must all be seen: ties go to the smaller id
            left = left[(bound[left] > 0) & (bound[left] >= floor - 1e-9)]
            if not len(left):
                break
            chosen = np.zeros(len(self.edges), bool)
            chosen[left[:step]] = True
            left, step = left[step:], len(self.edges)
            opened = chosen[block]
            here = entries[opened]
            found, sizes = _ranges(self.start[here], self.start[here + 1])
            # clipping is never needed; it spares a check of each place
            score += np.bincount(self.place.take(found, mode="clip"), np.repeat(own[opened], sizes) * self.weight.take(found, mode="clip"), len(score))
            seen |= np.repeat(chosen, BLOCK)[: len(score)]
            whole = score[seen]
            if len(whole) > k:
                floor = max(float(np.partition(whole, -k)[-k]), 0.0)
        places = np.flatnonzero(seen & (score >= max(floor - 1e-9, 1e-12)))
        best = places[np.lexsort((self.ids[places], -np.round(score[places], 12)))][:k]
        return best, score[best]

    def vote(self, places: np.ndarray, scores: np.ndarray, prior: float) -> float:
        """Share of toxic neighbours, each counted as one over its distance, with the prior as half a neighbour."""
        near = 1 / (1 - np.minimum(scores, 1) + NEAR)
        return float((near @ self.labels[places] + 0.5 * prior) / (near.sum() + 0.5))


def isotonic(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising fit of y on x: both ends of each pool of adjacent violators, smoothed by one half."""
    pools: list[list[float]] = []
    weights = np.ones(len(x)) if weights is None else weights
    for k in np.argsort(x, kind="stable"):
        pools.append([float(y[k] * weights[k]), float(weights[k]), float(x[k]), float(x[k])])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            total, n, _, top = pools.pop()
            pools[-1] = [pools[-1][0] + total, pools[-1][1] + n, pools[-1][2], top]
    rates = np.maximum.accumulate([(p[0] + 0.5) / (p[1] + 1.0) for p in pools])
    return np.array([p[2:] for p in pools]).ravel(), np.repeat(rates, 2)


def vector(found: np.ndarray, counts: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and weights of the known terms among hashes, of a vector of length one over all of them."""
    at = np.minimum(np.searchsorted(model["terms"], found), len(model["terms"]) - 1)
    same = model["terms"][at] == found
    weights = (1 + np.log(counts)) * np.where(same, model["weight"][at], model["unseen"])
    return at[same], weights[same] / np.sqrt(weights @ weights) if len(weights) else weights


def _bags(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for found, counts in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True):
        yield np.frombuffer(found, "<u8"), np.frombuffer(counts, "<u4")


def index_of(model: dict) -> Index:
    """The index of a model, made once by a worker."""
    held = kept_in_worker("toxicity", list)
    if not held or held[0] != model["key"]:
        numbers, counts = unpacked_ints(model["numbers"]).astype(np.int64), unpacked_ints(model["counts"])
        weights = (1 + np.log(counts)) * model["weight"][numbers]
        ends = np.cumsum(model["sizes"])
        pairs = [(numbers[a:z], weights[a:z] / np.sqrt(weights[a:z] @ weights[a:z])) for a, z in zip(ends - model["sizes"], ends, strict=True)]
        held[:] = [model["key"], Index(model["ids"].tolist(), model["labels"].tolist(), pairs, len(model["terms"]))]
    return held[1]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, k: int = NEIGHBOURS, entries: int = ENTRIES) -> dict:
    """Weights, index and calibration from a bounded sample of labelled rows."""
    spark = docs.sparkSession
    drawn, stands = _examples(docs, labels, sample)
    examples, _ = written(drawn, "examples")
    kept = examples.where(F.length("terms") > 0).select("doc_id", (F.length("terms") / 8).cast("bigint").alias("n"))
    # about `sample` rows of three numbers
    drawn_sizes = sorted(kept.select(F.xxhash64(F.lit(13), "doc_id").alias("h"), "doc_id", "n").collect())
    over = [r.doc_id for r, t in zip(drawn_sizes, np.cumsum([r.n for r in drawn_sizes]), strict=True) if t > entries]
    if over:
        examples = examples.where(~F.col("doc_id").isin(over))
    stand = np.array([stands.get(0, 1.0), stands.get(1, 1.0)])
    shares = {r.toxic: r["count"] * stand[r.toxic] for r in examples.groupBy("toxic").count().collect()}
    rate = (shares.get(1, 0) + 0.5) / (sum(shares.values()) + 2)
    model: dict = {"k": k, "rate": rate, "key": None}
    # at most `entries` terms of eight bytes, and their counts of four
    rows = sorted(examples.where(F.length("terms") > 0).collect(), key=lambda r: r.doc_id)
    if not rows or not shares.get(1):
        return model
    y = np.array([r.toxic for r in rows])
    sizes = np.array([len(r.terms) // 8 for r in rows])
    names, number = np.unique(np.frombuffer(b"".join(r.terms for r in rows), "<u8"), return_inverse=True)
    each = np.repeat(y, sizes)
    seen = np.bincount(number)
    toxic, all_ = np.bincount(number, each * stand[1]), np.bincount(number, stand[each])
    base, total = shares[1] / sum(shares.values()), sum(shares.values())
    telling = np.clip(2 * (_wilson(toxic / all_, seen, Z) - base) / max(1 - base, 1e-9), 0, 1)
    weight = (np.log((total + 1) / all_) + 0.1) * (FLOOR + (1 - FLOOR) * telling)
    model |= {"key": uuid.uuid4().hex, "terms": names, "weight": weight, "unseen": FLOOR * (np.log(total + 1) + 0.1), "prior": base}
    model |= {"ids": np.array([r.doc_id for r in rows]), "labels": y, "sizes": sizes, "numbers": packed_ints(number)}
    model["counts"] = packed_ints(np.frombuffer(b"".join(r.counts for r in rows), "<u4"))
    del rows, number, each
    sent = spark.sparkContext.broadcast(model)

    def leave_one_out(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, index = sent.value, index_of(sent.value)
        for batch in slices(parts, TOGETHER):
            near = index.nearest_each([vector(*bag, model) for bag in _bags(batch)], model["k"], batch.column("doc_id").to_pylist())
            votes = [index.vote(*found, model["prior"]) for found in near]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(votes, pa.float64())], ["doc_id", "toxic", "vote"])

    # about `sample` rows of three numbers; in an order of their own, so that sums do not vary
    left_out = examples.mapInArrow(leave_one_out, "doc_id bigint, toxic int, vote double").collect()
    votes = np.array(sorted((r.vote, r.toxic, r.doc_id) for r in left_out))
    at, rates = isotonic(votes[:, 0], votes[:, 1], stand[votes[:, 1].astype(int)])
    model["steps"] = (np.append(at, 1.0), np.append(rates, 1.0))
    return model


_EVIDENCE = "evidence array<struct<doc_id:bigint,toxic:int,similarity:double>>"


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """Score and evidence for each document."""
    chosen = docs.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    one = pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("similarity", pa.float64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        index = index_of(held) if held["key"] else None
        for batch in slices(parts, TOGETHER):
            scores, evidence = [held["rate"]] * batch.num_rows, [[]] * batch.num_rows
            if index is not None:
                near = index.nearest_each([vector(*bag, held) for bag in bags(texts(batch, "text"))], held["k"])
                for n, (places, like) in enumerate(near):
                    scores[n] = float(np.interp(index.vote(places, like, held["prior"]), *held["steps"]))
                    evidence[n] = [{"doc_id": int(index.ids[p]), "toxic": int(index.labels[p]), "similarity": float(s)} for p, s in zip(places[:5], like[:5], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(one))], ["doc_id", "held_out", "score", "evidence"])

    found = chosen.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, {_EVIDENCE}")
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
