"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

Codes: vectors are centred, projected on several learned rotations (principal
axes of a bounded sample, then alternating sign and Procrustes steps) and cut
to signs.  Each code is split into substrings of 8 or 16 bits; a shard of the
index keeps, for every substring, its rows sorted by value.  A query within
Hamming radius R of a code agrees with it in some substring up to R // m
flips, so probing those values in every substring retrieves each code within
R; what is retrieved is filtered by the full distance and ranked by the inner
product of the original vectors in double precision.

The radius is learned on the sample so that a stated share of true neighbours
lies within it; a shard that finds fewer than ``k`` widens the radius until it
has ``k`` or all its rows.  The ``k`` nearest of a table are about as near as
the ``k`` * sample / rows nearest of the sample; the radius is taken at one
neighbour more, on the safe side.  Substrings have the length for which that
radius asks for less work.  Where the values to be probed outnumber the rows of
the shard, all its codes are compared instead, with the same rows as the result.

Every row is indexed.  Shards are input splits, so no key can be hot.  Queries
are a stated set and are sent in blocks of about ``query_values`` numbers; a
shard answers with its best ``k`` per query, merged by one aggregation.

Defined results: vectors that are null, empty, zero, or hold null or
non-finite numbers take no part, nor do those of another length than most of
the sample; equal vectors tie and the smaller id comes first; repeated ids are
separate candidates but never their own query's; columns beside id and vector
are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import written

SAMPLE = 4_000
TABLES = 4
RECALL = 0.98
#: Numbers in the vectors of a block of queries.
QUERY_VALUES = 2_000_000
SHARD_ROWS = 32_768
#: Lengths of substrings, in bits.
WIDTHS = (8, 16)


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) with the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.col(id_col).isNotNull()
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    nonzero = F.exists(v, lambda x: x != 0)
    return vectors.where(fine & F.coalesce(finite, F.lit(False)) & F.coalesce(nonzero, F.lit(False))).select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"))


def learn(sample: np.ndarray, tables: int = TABLES, k: int = 20, recall: float = RECALL, seed: int = 7, rows: int = 0) -> dict:
    """Centre, rotations, radius and length of substrings from a sample of unit-free vectors of a table of ``rows``."""
    model = rotations(sample, tables, seed)
    return model | probing(sample, model, k, recall, seed, max(rows, len(sample)))


def rotations(sample: np.ndarray, tables: int = TABLES, seed: int = 7) -> dict:
    """Centre and learned rotations."""
    rng = np.random.default_rng(seed)
    centre = sample.mean(axis=0)
    x = sample - centre
    dim = x.shape[1]
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1]
    projections = []
    for _ in range(tables):
        turn, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
        y = x @ axes
        for _ in range(20):
            signs = np.where(y @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ y)
            turn = (left @ right).T
        projections.append(axes @ turn)
    return {"centre": centre, "projection": np.hstack(projections)}


def probing(sample: np.ndarray, model: dict, k: int, recall: float, seed: int, rows: int) -> dict:
    """Radius that holds a share of the true neighbours, and the length of substrings that it asks for."""
    rng = np.random.default_rng(seed + 1)
    codes = encode(sample, model)
    bits = codes.shape[1] * 8
    chosen = rng.choice(len(sample), min(len(sample), 300), replace=False)
    near_by = min(k, -(-k * len(sample) // rows) + 1, len(sample) - 1)
    needed = []
    for q in chosen:
        score = sample @ sample[q]
        score[q] = -np.inf
        near = np.argsort(-score)[:near_by]
        needed += np.bitwise_count(codes[near] ^ codes[q]).sum(axis=1).tolist()
    radius = int(np.quantile(needed, recall)) if needed else bits
    widths = [w for w in WIDTHS if bits % w == 0]
    return {"radius": radius, "width": min(widths, key=lambda w: work(bits, w, radius))}


def work(bits: int, width: int, radius: int, rows: int = SHARD_ROWS) -> float:
    """Values probed and rows retrieved by a query in a shard of evenly spread codes."""
    parts = bits // width
    values = parts * sum(math.comb(width, flips) for flips in range(min(width, radius // parts) + 1))
    return min(values, rows) + min(rows * values / 2**width, rows)


def encode(x: np.ndarray, model: dict) -> np.ndarray:
    """Rows of bytes; each byte, or two together, is one substring of the code."""
    return np.packbits((x - model["centre"]) @ model["projection"] >= 0, axis=1)


class Shard:
    """Multi-index over one set of rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, width: int = 8):
        self.ids, self.x, self.codes, self.width = ids, x, codes, width
        words = self._words(codes)
        self.parts = words.shape[1]
        orders = [np.argsort(words[:, p], kind="stable") for p in range(self.parts)]
        starts = [np.searchsorted(words[o, p], np.arange((1 << width) + 1)) + p * len(ids) for p, o in enumerate(orders)]
        self.order, self.starts = np.concatenate(orders), np.array(starts)
        flips = np.arange(1 << width)
        weight = np.bitwise_count(flips)
        self.flips = [flips[weight == w] for w in range(width + 1)]

    def _words(self, codes: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(codes).view(f"<u{self.width // 8}")

    def retrieve(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows that agree with a code in some substring up to the flips that the pigeonhole principle asks for."""
        reach = min(self.width, radius // self.parts)
        if sum(math.comb(self.width, flips) for flips in range(reach + 1)) * self.parts >= len(self.ids):
            return np.arange(len(self.ids))
        masks = np.concatenate(self.flips[: reach + 1])
        values = masks[None, :] ^ self._words(code).astype(np.int64)[:, None]
        part = np.arange(self.parts)[:, None]
        first = self.starts[part, values].ravel()
        sizes = self.starts[part, values + 1].ravel() - first
        ends = np.cumsum(sizes)
        places = np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1])
        seen = np.zeros(len(self.ids), bool)
        seen[self.order[places]] = True
        return np.flatnonzero(seen)

    def probe(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code lies within ``radius``."""
        rows = self.retrieve(code, radius)
        distance = np.bitwise_count(self.codes[rows] ^ code).sum(axis=1)
        return rows[distance <= radius]

    def nearest(self, query_id: int, q: np.ndarray, code: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the best ``k`` found."""
        bits = self.width * self.parts
        while True:
            rows = self.probe(code, radius)
            rows = rows[self.ids[rows] != query_id]
            if len(rows) >= k or radius >= bits:
                break
            radius = min(bits, radius + max(8, bits // 16))
        score = (self.x[rows] * q).sum(axis=1)
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][best], score[best]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest(
    vectors: DataFrame,
    every: int = 20,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample: int = SAMPLE,
    tables: int = TABLES,
    query_values: int = QUERY_VALUES,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """The ``k`` nearest rows found for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    taking = valid(vectors, id_col, vector_col)
    # a bounded sample in an order of its own, the same on each run
    drawn = [r.v for r in taking.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()]
    if not drawn:
        return empty
    dim = Counter(map(len, drawn)).most_common(1)[0][0]
    fitted = np.array([v for v in drawn if len(v) == dim])
    turned = rotations(fitted, tables)
    sent = spark.sparkContext.broadcast(turned)

    def code(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            if batch.num_rows:
                codes = encode(_matrix(batch.column("v"), dim), sent.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes])], [*batch.schema.names, "code"])

    index, _ = written(taking.where(F.size("v") == dim).mapInArrow(code, "vec_id bigint, v array<double>, code binary"), "codes")
    model = spark.sparkContext.broadcast(turned | probing(fitted, turned, k, RECALL, 7, max(index.count(), len(fitted))))
    queries = index.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-queries.count() * dim // query_values))
    found = None
    for block in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)
        part = _answered(index, own, model, dim, k, shard_rows)
        if blocks > 1:
            part, _ = written(part, "neighbours")
        found = part if found is None else found.unionByName(part)
    return found


def _answered(index: DataFrame, queries: DataFrame, model, dim: int, k: int, shard_rows: int) -> DataFrame:
    rows = queries.select("vec_id", "v", "code").distinct().collect()  # at most one block
    asked = index.sparkSession.sparkContext.broadcast(
        (
            np.array([r.vec_id for r in rows], np.int64),
            np.array([r.v for r in rows], np.float64).reshape(-1, dim),
            np.array([np.frombuffer(r.code, np.uint8) for r in rows], np.uint8),
        )
    )
    schema = pa.schema([("query_id", pa.int64()), ("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def answer(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in parts:
            held.append(batch)
            if sum(b.num_rows for b in held) >= shard_rows:
                yield from search(held)
                held = []
        if held:
            yield from search(held)

    def search(held: list) -> Iterator[pa.RecordBatch]:
        held = [b for b in held if b.num_rows]
        if not held:
            return
        ids = np.concatenate([b.column("vec_id").to_numpy() for b in held])
        x = np.concatenate([_matrix(b.column("v"), dim) for b in held])
        codes = np.concatenate([np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1) for b in held])
        shard = Shard(ids, x, codes, model.value["width"])
        query_ids, q, query_codes = asked.value
        for at in range(0, len(query_ids), 500):
            got = [(n, *shard.nearest(query_ids[n], q[n], query_codes[n], model.value["radius"], k)) for n in range(at, min(at + 500, len(query_ids)))]
            sizes = [len(g[1]) for g in got]
            numbers = np.repeat([g[0] for g in got], sizes).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_ids[numbers]), pa.array(numbers), pa.array(np.concatenate([g[1] for g in got])), pa.array(np.concatenate([g[2] for g in got]))],
                schema=schema,
            )

    best = index.mapInArrow(answer, "query_id bigint, q bigint, vec_id bigint, score double")
    # at most k rows per query and shard reach the merge
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
