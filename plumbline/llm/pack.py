"""Hierarchical multi-length packing of tokenised documents.

Documents are routed to context tiers (powers of two up to the longest
window).  What is longer than the longest window fills windows of its own; the
rest goes to the smallest tier that holds it.  Each tier is packed from the
longest down: a piece opens a window and the gap behind it is filled with
pieces of shorter tiers, best fit first; only when none fits is one cut.  A
full window has a tier's length, so nothing is padded but one window in each
task, whose last tokens make no tier.

Packing runs where the rows lie: a task packs its own input split, in lots of
``lot`` documents, and carries open windows on to the next lot.  Nothing is
shuffled and no key can be hot.  Step groups then take equal numbers of tokens
of one tier from the windows of all tasks; only one row per task and tier is
moved for that.

Defined results: a null or empty text is its end token alone; equal rows are
packed each for itself; columns beside id and text are ignored, whatever their
names; an empty table gives no rows.  Which window a piece lies in depends on
how the input is split into files and tasks; ids, pieces and lengths add up in
any split.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import ordered
from plumbline.llm.common import kept_in_worker, task_block, texts, written

TIERS = (64, 128, 256, 512, 1024)
STEP_TOKENS = 65_536
LOT = 2_048
#: Words that a worker remembers.
REMEMBERED = 1_000_000
END = 0


class CachedTokenizer:
    """Ids of a byte-level tokenizer whose pieces never cross a blank, word by word from memory.

    A text with other white space than single blanks and line ends, or with
    what may be a special token, goes to the tokenizer as a whole.
    """

    def __init__(self, path: str, most: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.after_blank: dict[str, bytes] = {}
        self.at_start: dict[str, bytes] = {}
        self.line_end = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> bool:
        """Ids of words behind a blank, many at a time: their pieces start at the blanks.  False if one is no plain word."""
        words = list(set(words))
        if any(not w or len(w.split()) != 1 or w[0].isspace() or w[-1].isspace() for w in words):
            return False
        found = self.tokenizer.encode("".join([" " + w for w in words]), add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        first = np.fromiter((place[0] for place in found.offsets), np.int64, len(found.offsets))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        cuts = (np.searchsorted(first, np.append(0, np.cumsum(sizes))) * 4).tolist()
        self.after_blank.update(zip(words, [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
        return True

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text:
            return self._whole(text)
        if len(self.after_blank) > self.most:
            self.after_blank.clear()
        if len(self.at_start) > self.most:
            self.at_start.clear()
        lines = [line.split(" ") for line in text.split("\n")]
        known, out = self.after_blank.get, []
        for line in lines:
            head = self.at_start.get(line[0])
            if head is None:
                if len(line[0].split()) != 1 or line[0][0].isspace() or line[0][-1].isspace():
                    return self._whole(text)
                head = self.at_start[line[0]] = self._whole(line[0])
            out.append(head)
            out += map(known, line[1:])
            out.append(self.line_end)
        out.pop()
        if None in out:
            words = [w for line in lines for w in (*line, None)]
            missing = [k for k, ids in enumerate(out) if ids is None]
            if not self._learn([words[k] for k in missing]):
                return self._whole(text)
            for k in missing:
                out[k] = known(words[k])
        return b"".join(out)


class Packer:
    """Packs pieces (document number, start, ids) into windows of the tiers."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = sorted(tiers)
        if any(t & (t - 1) for t in self.tiers):
            raise ValueError("tiers are powers of two")
        self.longest = self.tiers[-1]
        self.pools: dict[int, list] = {t: [] for t in self.tiers}
        self.order = 0

    def add(self, document: tuple, ids: bytes) -> Iterator[list]:
        """Full windows of the document; the rest waits in its pool."""
        n, width, start = len(ids) // 4, self.longest, 0
        while n - start >= width:
            yield [(document, start, ids[start * 4 : (start + width) * 4])]
            start += width
        if start < n:
            self._route((document, start, ids[start * 4 :]))

    def _route(self, piece: tuple) -> None:
        tier = self.tiers[bisect.bisect_left(self.tiers, len(piece[2]) // 4)]
        self.order += 1
        bisect.insort(self.pools[tier], (len(piece[2]) // 4, self.order, piece))

    def _fit(self, gap: int, below: int) -> tuple | None:
        """The longest waiting piece of a tier up to ``below`` that fits the gap, else a cut of the shortest one."""
        for tier in reversed(self.tiers):
            pool = self.pools[tier]
            if tier <= below and pool and (at := bisect.bisect_right(pool, (gap, 1 << 62, ()))):
                return pool.pop(at - 1)[2]
        for tier in self.tiers:
            if tier <= below and self.pools[tier]:
                document, start, ids = self.pools[tier].pop(0)[2]
                self._route((document, start + gap, ids[gap * 4 :]))
                return document, start, ids[: gap * 4]
        return None

    def windows(self) -> Iterator[list]:
        """Pack each tier; a window that stays open goes back to the pools."""
        for tier in reversed(self.tiers):
            waiting, self.pools[tier] = self.pools[tier], []
            back = []
            for _, _, piece in reversed(waiting):
                window, room = [piece], tier - len(piece[2]) // 4
                while room and (filler := self._fit(room, tier // 2)):
                    window.append(filler)
                    room -= len(filler[2]) // 4
                if room:
                    back += window
                else:
                    yield window
            for piece in back:
                self._route(piece)

    def rest(self) -> Iterator[list]:
        """All that waits, cut into windows of the longest tiers that it fills; the last one may be short."""
        waiting = [piece for tier in reversed(self.tiers) for _, _, piece in reversed(self.pools[tier])]
        self.pools = {t: [] for t in self.tiers}
        total = sum(len(p[2]) // 4 for p in waiting)
        while total:
            room = next((t for t in reversed(self.tiers) if t <= total), total)
            total -= room
            window = []
            while room:
                document, start, ids = waiting.pop(0)
                n = len(ids) // 4
                if n > room:
                    waiting.insert(0, (document, start + room, ids[room * 4 :]))
                    ids, n = ids[: room * 4], room
                window.append((document, start, ids))
                room -= n
            yield window


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    tiers: tuple[int, ...] = TIERS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lot: int = LOT,
    keep_ids: bool = False,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """One row per piece: place in its document, place in its window, crc32 of its ids, and its tier.

    ``tokenizer_path`` must be readable by the executors (an installed file);
    ``keep_ids`` adds the ids as little-endian unsigned 32-bit integers;
    ``remembered`` bounds the words that a worker keeps, for its memory.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "task", "place"]
    schema = f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in names[1:]) + (", ids binary" if keep_ids else "")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept_in_worker(f"tokenizer {tokenizer_path} {remembered}", lambda: CachedTokenizer(tokenizer_path, remembered))
        packer, task, counts, number = Packer(tiers), task_block(), {}, 0
        rows: list[tuple] = []

        def put(window: list) -> None:
            nonlocal number
            n = sum(len(p[2]) // 4 for p in window)
            tier = next(t for t in packer.tiers if t >= n)
            place, offset = counts.get(tier, 0), 0
            counts[tier] = place + 1
            for (doc, doc_tokens), start, ids in window:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, (task << 33) + number, offset, tier, task, place, ids))
                offset += len(ids) // 4
            number += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            arrays = [pa.array(columns[0], doc_type), *(pa.array(c, pa.int64()) for c in columns[1:10])]
            if keep_ids:
                return pa.RecordBatch.from_arrays([*arrays, pa.array(columns[10], pa.binary())], [*names, "ids"])
            return pa.RecordBatch.from_arrays(arrays, names)

        doc_type, seen = None, 0
        for batch in parts:
            doc_type = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch, "text"), strict=True):
                ids = encode(text) + END.to_bytes(4, "little")
                for window in packer.add((doc, len(ids) // 4), ids):
                    put(window)
                seen += 1
                if seen % lot == 0:
                    for window in packer.windows():
                        put(window)
                if len(rows) >= 10_000:
                    yield out()
        for window in (w for step in (packer.windows(), packer.rest()) for w in step):
            put(window)
        if rows:
            yield out()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def with_steps(packed: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Adds ``step``: groups of windows of one tier that hold ``step_tokens`` together.

    Windows are numbered through all tasks of a tier, so each step but a
    tier's last is full, whatever the size of the tasks.
    """
    held, _ = written(packed, "packed")
    counts = held.groupBy("tier", "task").agg((F.max("place") + 1).alias("windows"))
    bases = ordered.running_total(ordered.ordered_chunks(counts, ["tier"], ["task"]), ["tier"], ["task"], "windows", "base")
    joined = held.join(bases.select("tier", "task", "base"), ["tier", "task"])
    step = F.floor((F.col("base") + F.col("place")) * F.col("tier") / F.lit(step_tokens))
    return joined.select(*held.columns, step.cast("bigint").alias("step"))
