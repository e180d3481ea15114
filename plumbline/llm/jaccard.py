"""N-gram Jaccard join by chosen paths.

A text is the set of its ``width``-word shingles.  Equal sets are one class
and are represented by their smallest id.  Each run walks a tree of shared
tokens: at a node, a set follows each of its tokens whose hash (one hash
function for each run and depth) falls below 1 / (threshold * size), about
1 / threshold of them, so two sets as similar as the threshold go on together
with a fixed chance at each depth.  A node with few sets is compared by brute
force; one with more is split further, down to ``depth`` levels.  Runs are
repeated until the chance that a pair at the threshold meets at least once
reaches ``recall``.

What is still large at the last level is a dense group of near copies.  It is
compared in tiles of ``tile`` by ``tile`` sets, spread over tasks, by one
matrix product per tile; neither pairs nor links leave a tile, only the number
of links of each set and the edges of a forest that connects it.  A pair that
meets in several nodes is counted in the first of them only, known from the
nodes that both sets list.  A link is verified on whole sets (32-bit shingle
hashes; nodes and equal sets are told apart by 64 and 128 bits).

Classes are the connected components of the links, found by rounds of
neighbour minimum and pointer jumping over tables.

Defined results: a text with fewer words than ``width``, but not none, is one
shingle; null and empty texts have no shingles, no links and a class each of
their own; equal rows are copies of each other; a null id is kept and never
represents a class that has another id; columns beside id and text are ignored, whatever their
names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import (
    WORD_BYTES,
    digest128,
    encoded,
    mix,
    packed_sorted,
    range_hashes,
    removed,
    rolling,
    texts,
    unpacked_sorted,
    word_places,
    written,
)

WIDTH = 5
THRESHOLD = 0.8
RECALL = 0.99
DEPTH = 3
LEAF = 64
#: Sets and tokens on a side of a tile.
TILE = 1_024
TILE_TOKENS = 2_000_000

_BLANK = np.zeros(256, bool)
_BLANK[32] = True


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted set of shingle hashes of a text."""
    data = encoded(text).translate(WORD_BYTES)
    words = range_hashes(data, *word_places(data, _BLANK))
    return np.unique(rolling(words, min(width, len(words)))) if len(words) else words


def runs_needed(recall: float) -> int:
    """Runs until a pair at the threshold has met with the wanted chance.

    A pair with similarity t shares at least t times the larger set's tokens
    and follows each with probability 1 / (t * that size): the number followed
    together at a level has a mean of at least 1.  The tokens of a level are
    the same at all nodes of a run, so a pair gets through a run if it follows
    a token together at each level.  Most pairs part from the rest at the
    first level and meet far more surely.
    """
    alive = (1 - math.exp(-1)) ** DEPTH
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def steps(tokens: np.ndarray, run: int, threshold: float, depth: int) -> list[list[int]]:
    """Tokens that a set follows in a run, at each depth."""
    limit = min(1.0, 1 / (threshold * len(tokens))) if len(tokens) else 0.0
    bound = np.uint64(min(int(limit * 2**64), 2**64 - 1))
    out = []
    for level in range(depth):
        hashed = mix(tokens ^ np.uint64((run * 64 + level + 1) * 0x9E3779B97F4A7C15 % 2**64))
        out.append(tokens[hashed <= bound].view(np.int64).tolist())
    return out


def _records(docs: DataFrame, width: int, threshold: float, runs: int, depth: int) -> DataFrame:
    """(doc_id, mark, class key, size, steps by run and depth) of each text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            keys, sizes, paths = [], [], []
            for text in texts(batch, "text"):
                tokens = shingles(text, width)
                keys.append(digest128(tokens.tobytes()) if len(tokens) else None)
                sizes.append(len(tokens))
                paths.append([steps(tokens, r, threshold, depth) for r in range(runs)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("mark"),
                    pa.array(keys, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(paths, pa.list_(pa.list_(pa.list_(pa.int64())))),
                ],
                ["doc_id", "mark", "key", "size", "paths"],
            )

    return docs.mapInArrow(run, "doc_id bigint, mark bigint, key binary, size bigint, paths array<array<array<bigint>>>")


def _leaves(classes: DataFrame, depth: int, leaf: int) -> DataFrame:
    """(rank, size, node) for each set and each node where it is compared with others.

    ``classes`` has (rank, size, paths).  Nodes with one set end; nodes with up
    to ``leaf`` sets and those of the last level are leaves; others are split.
    """
    state = classes.select("rank", "size", F.posexplode("paths").alias("run", "path"))
    state = state.select("rank", "size", "run", F.explode(F.element_at("path", 1)).alias("token"))
    state = state.select("rank", "size", "run", F.xxhash64("run", "token").alias("node"))
    out = None
    for level in range(1, depth + 1):
        held, _ = written(state, f"nodes{level}")
        counts = held.groupBy("node").agg(F.count("*").alias("sets")).where(F.col("sets") > 1)
        alive = held.join(counts, "node")
        done = (alive if level == depth else alive.where(F.col("sets") <= leaf)).select("rank", "size", "node")
        out = done if out is None else out.unionByName(done)
        if level < depth:
            paths = classes.select("rank", "paths")
            split = alive.where(F.col("sets") > leaf).select("rank", "size", "run", "node").join(paths, "rank")
            split = split.select("rank", "size", "run", "node", F.explode(F.element_at(F.element_at("paths", F.col("run") + 1), level + 1)).alias("token"))
            state = split.select("rank", "size", "run", F.xxhash64("node", "token").alias("node"))
    return written(out.distinct(), "leaves")[0]


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rank, tokens) of the wanted rows, which name a text by id and mark."""
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    chosen = docs.join(wanted.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "rank"), same).select("rank", "text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            sets = [packed_sorted(np.unique(shingles(text, width) >> np.uint64(32))) for text in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("rank"), pa.array(sets, pa.binary())], ["rank", "tokens"])

    # equal rows carry the same set
    return chosen.mapInArrow(run, "rank bigint, tokens binary").groupBy("rank").agg(F.first("tokens").alias("tokens"))


def _tiled(leaves: DataFrame, sets: DataFrame, tile: int, tile_tokens: int) -> DataFrame:
    """One row per set and tile of a node: (rank, node, part, a, b, copies, tokens, nodes)."""
    listed = leaves.groupBy("rank").agg(F.collect_list("node").alias("nodes"))  # a few per run
    # nodes with the same sets need one comparison: the first of them does it
    member = F.xxhash64("rank").cast("decimal(38,0)")
    nodes = leaves.groupBy("node").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum(member).alias("s"), F.bit_xor(F.xxhash64(F.lit(5), "rank")).alias("x"))
    first = nodes.groupBy("n", "size", "s", "x").agg(F.min("node").alias("node"))
    parts = F.ceil(F.greatest(F.col("n") / tile, F.col("size") / tile_tokens)).cast("int")
    placed = leaves.select("rank", "node").join(first.select("node", parts.alias("parts")), "node")
    placed = placed.withColumn("part", F.pmod(F.xxhash64(F.lit(3), "rank"), F.col("parts")).cast("int"))
    spots = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("a"), F.greatest(o, F.col("part")).alias("b")))
    dealt = placed.select("rank", "node", "part", F.explode(spots).alias("t")).select("rank", "node", "part", "t.a", "t.b")
    return dealt.join(sets.join(listed, "rank"), "rank")


_LINK = pa.schema([("rank", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])


def _compared(tiles: DataFrame, threshold: float) -> DataFrame:
    """From the tiles: (rank, null, links) with the number of linked texts, and (rank, other, null) with edges of a forest."""

    def compare(node: int, a: int, b: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        left = [r for r in rows if r["part"] == a]
        right = left if a == b else [r for r in rows if r["part"] == b]
        if not left or not right or (a == b and len(left) < 2):
            return
        both = left if a == b else left + right
        tokens = [unpacked_sorted(r["tokens"]) for r in both]
        size = np.array([len(t) for t in tokens], np.float64)
        names, which, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(both)), size.astype(np.int64))
        # tokens of every set add the same to all intersections, those of one set nothing
        everywhere = count == len(both)
        middle = (count > 1) & ~everywhere
        column = np.cumsum(middle) - 1
        use = middle[which]
        rows_, columns_ = owner[use], column[which[use]]
        n = len(left)
        ra, rb = np.arange(n), (np.arange(n) if a == b else np.arange(n, len(both)))
        shared = np.full((len(ra), len(rb)), float(everywhere.sum()), np.float32)
        width = int(middle.sum())
        for at in range(0, width, 8_192):
            now = (columns_ >= at) & (columns_ < at + 8_192)
            matrix = np.zeros((len(both), min(8_192, width - at)), np.float32)
            matrix[rows_[now], columns_[now] - at] = 1
            shared += matrix[ra] @ matrix[rb].T
        total = size[ra][:, None] + size[rb][None, :] - shared
        close = shared >= threshold * total - 1e-6
        if a == b:
            np.fill_diagonal(close, False)
        x, y = np.nonzero(close)
        if a == b:
            x, y = x[x < y], y[x < y]
        if not len(x):
            return
        # counted where the smallest node of both lies
        earlier = [{m for m in r["nodes"] if m < node} for r in both]
        firsts = sorted({m for s in earlier for m in s})
        if firsts:
            at = {m: k for k, m in enumerate(firsts)}
            seen = np.zeros((len(both), len(firsts)), np.float32)
            for k, s in enumerate(earlier):
                seen[k, [at[m] for m in s]] = 1
            before = (seen[ra] @ seen[rb].T) > 0
            new = ~before[x, y]
            x, y = x[new], y[new]
            if not len(x):
                return
        p, q = ra[x], rb[y]
        ranks = np.array([r["rank"] for r in both], np.int64)
        weight = np.array([r["copies"] for r in both], np.int64)
        links = np.bincount(p, weight[q], len(both)) + np.bincount(q, weight[p], len(both))
        linked = np.flatnonzero(links)
        # a star over each set of connected texts: as many edges as texts
        near = np.zeros((len(both), len(both)), bool)
        near[p, q] = near[q, p] = True
        heads, tails = [], []
        waiting = links > 0
        while waiting.any():
            start = int(np.flatnonzero(waiting)[0])
            front = np.zeros(len(both), bool)
            front[start] = True
            waiting[start] = False
            while front.any():
                front = near[front].any(axis=0) & waiting
                waiting &= ~front
                tails.append(np.flatnonzero(front))
                heads.append(np.full(len(tails[-1]), start))
        yield pa.RecordBatch.from_arrays([pa.array(ranks[linked]), pa.nulls(len(linked), pa.int64()), pa.array(links[linked].astype(np.int64))], schema=_LINK)
        heads, tails = np.concatenate(heads), np.concatenate(tails)
        yield pa.RecordBatch.from_arrays([pa.array(ranks[heads]), pa.array(ranks[tails]), pa.nulls(len(heads), pa.int64())], schema=_LINK)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = [], None
        for batch in parts:
            for row in batch.to_pylist():
                spot = (row["node"], row["a"], row["b"])
                if held and spot != own:
                    yield from compare(*own, held)
                    held = []
                own = spot
                held.append(row)
        if held:
            yield from compare(*own, held)

    dealt = tiles.repartition("node", "a", "b").sortWithinPartitions("node", "a", "b", "rank")
    return dealt.mapInArrow(run, "rank bigint, other bigint, links bigint")


def components(edges: DataFrame) -> DataFrame:
    """(rank, root) for the ends of (rank, other) edges; the root is the smallest rank connected.

    Each round takes the smallest label among neighbours and then the label of
    that label, so labels cross long chains in few rounds.
    """
    both = edges.select(F.col("rank").alias("x"), F.col("other").alias("y"))
    both, _ = written(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels, old = written(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("root")), "roots")
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), "root"), "y").groupBy("x").agg(F.min("root").alias("near"))
        merged = labels.join(near, "x").select("x", F.least("root", "near").alias("low"), "root")
        jump = labels.select(F.col("x").alias("low"), F.col("root").alias("far"))
        after = merged.join(jump, "low").select("x", F.least("low", "far").alias("root"), (F.least("low", "far") < F.col("root")).alias("moved"))
        fresh, path = written(after, "roots")
        moved = fresh.where("moved").limit(1).count()
        labels = fresh.select("x", "root")
        removed(edges.sparkSession, old)
        old = path
        if not moved:
            return labels.select(F.col("x").alias("rank"), "root")


def near_duplicates(
    docs: DataFrame,
    width: int = WIDTH,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    depth: int = DEPTH,
    leaf: int = LEAF,
    tile: int = TILE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: ``class_id``, the smallest id connected with it; ``n_links``, the documents it is linked to; ``first``, whether it stays.

    Documents with equal sets link to each other; ``n_copies`` counts them.
    One row of each class has ``first``.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold lies in (0, 1]")
    found, _ = _classified(docs, width, threshold, recall, depth, leaf, tile, id_col, text_col)
    return found.drop("mark")


def _classified(docs: DataFrame, width: int, threshold: float, recall: float, depth: int, leaf: int, tile: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    runs = runs_needed(recall)
    text = F.col(text_col).cast("string")
    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    # rows get numbers, since ids may repeat or be missing
    records, _ = written(_records(chosen, width, threshold, runs, depth).withColumn("row", F.monotonically_increasing_id()), "sets")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col("row").alias("rank"), "mark", "size")
    classes = records.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(order).alias("lead"), F.count("*").alias("copies"))
    classes, _ = written(classes.select("key", "lead.doc_id", "lead.rank", "lead.mark", "lead.size", "copies"), "classes")
    # the row that leads a class carries its steps
    led = records.select(F.col("row").alias("rank"), "size", "paths").join(classes.select("rank"), "rank")
    leaves = _leaves(led, depth, leaf)
    wanted = classes.join(leaves.select("rank").distinct(), "rank", "left_semi")
    sets = _sets(chosen, wanted, width).join(classes.select("rank", "copies"), "rank")
    found, _ = written(_compared(_tiled(leaves, sets, tile, TILE_TOKENS), threshold), "links")
    links = found.where(F.col("links").isNotNull()).groupBy("rank").agg(F.sum("links").alias("links"))
    roots = components(found.where(F.col("other").isNotNull()).select("rank", "other"))
    joined = classes.join(links, "rank", "left").join(roots, "rank", "left").withColumn("root", F.coalesce("root", "rank"))
    lowest = joined.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col("rank").alias("row"))).alias("best"))
    named = joined.join(lowest, "root").select(
        "key",
        F.col("best.id").alias("class_id"),
        F.col("best.row").alias("keeper"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        (F.col("copies") - 1).alias("n_copies"),
    )
    rows = records.select("doc_id", "mark", "row", "key")
    none = F.lit(0).cast("bigint")
    alone = rows.where(F.col("key").isNull()).select("doc_id", "mark", F.col("doc_id").alias("class_id"), none.alias("n_links"), none.alias("n_copies"), F.lit(True).alias("first"))
    classed = rows.join(named, "key").select("doc_id", "mark", "class_id", "n_links", "n_copies", (F.col("row") == F.col("keeper")).alias("first"))
    return classed.unionByName(alone), records


#: A letter or digit of a word, or any sign beyond ASCII.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that lead their class, in their own columns.

    Rows that are equal in id and text are one document and stay once; all rows
    without words stay.
    """
    found, records = _classified(docs, WIDTH, threshold, RECALL, DEPTH, LEAF, TILE, "doc_id", "text")
    name, mark = "_id", "_mark"
    while name in docs.columns or mark in docs.columns:
        name, mark = f"_{name}", f"_{mark}"
    kept = found.where("first").select(F.col("doc_id").alias(name), F.col("mark").alias(mark)).distinct()
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(name)) & (F.xxhash64(F.col("text").cast("string")) == F.col(mark))
    out = docs.join(kept, same, "left_semi")
    repeated = records.where(F.col("key").isNotNull()).groupBy("doc_id", "mark").count().where("count > 1").limit(1).count()
    if not repeated:
        return out
    worded = F.coalesce(F.col("text").cast("string").rlike(_WORD), F.lit(False))
    return out.where(~worded).unionByName(out.where(worded).dropDuplicates(["doc_id", "text"]))


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "class_id", "n_links", "n_copies")
