"""Alignment of two tokenizers over a corpus, each distinct text tokenised once.

Texts are shuffled whole and counted; every distinct one is tokenised by both
tokenizers and cut into groups at the byte offsets where tokens of both end.
The last tokens of a group end together and are a link.  How many links hold a
pair of ids is counted over the whole corpus, each text as often as it occurs.

Neither tokenizer joins text over a blank or line end that follows a letter,
digit or sign, so texts are put together from segments (white space and what
follows it), of which a worker remembers those of one word.  Texts with a
segment that does not come back byte for byte are tokenised whole.

A task gathers texts to chunks of ``CHUNK_LINKS`` links.  A chunk names its
pairs once, with their number; rows of (pair, chunk) are summed by pair and
the sums go back to the chunks, where each text looks its links up.  A pair that
stands in every text is one row per chunk.  The measures of a text meet its
documents by the SHA-256 of the text.

Defined results: null and empty texts, and texts that a tokenizer does not give
back byte for byte, have no tokens; repeated rows and ids each get a row, null ids
too; columns beside id and text are ignored, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import kept_in_worker, packed_ints, packed_sorted, task_block, texts, unpacked_ints, unpacked_sorted, written

CHUNK_LINKS = 3_000_000
#: Segments that a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 200_000, 64
#: A pair is the id of the first tokenizer times this, plus the id of the second.
PAIR = 1 << 24
#: Where segments begin, and white space of more than one sign.
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_RUN = re.compile(r"\s\s")


def byte_alphabet() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """Ids of a text by a byte-level tokenizer file, and the bytes of each id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        alphabet = byte_alphabet()
        self.bytes = {i: bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode() for token, i in self.tokenizer.get_vocab().items()}

    def __call__(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class Pieces:
    """Ids of a text by a sentencepiece model, which adds a blank before it, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = {}
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes[i] = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def __call__(self, text: str) -> list[int]:
        """A blank at the start is the one that the model adds; before a line end its token stands alone and is dropped."""
        return self.model.encode(text[1:]) if text[0] == " " else self.model.encode(text)[1:]


class Aligner:
    """Aligned tokens of whole texts, put together from remembered segments."""

    NOTHING = (0, 0, 0, "", b"")

    def __init__(self, first_path: str, second_path: str, remembered: int = REMEMBERED):
        self.first, self.second = ByteLevel(first_path), Pieces(second_path)
        if any(not data for side in (self.first, self.second) for data in side.bytes.values()):
            raise ValueError("a token without bytes")
        self.sizes = [np.array([len(side.bytes.get(i, b"")) for i in range(max(side.bytes) + 1)]) for side in (self.first, self.second)]
        #: Ids as text with what follows them: inside a group and at its end, for both tokenizers.
        self.names = [f"{i}{sign}" for sizes, signs in zip(self.sizes, (",|", ",;"), strict=True) for sign in signs for i in range(len(sizes))]
        self.name_sizes = np.array(list(map(len, self.names)))
        self.remembered = remembered
        self.known: dict[str | tuple, tuple] = {}
        self.older: dict[str | tuple, tuple] = {}

    def _ids(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of both tokenizers, or None if one does not give the text back."""
        wanted, out = text.encode(), []
        for side in (self.first, self.second):
            ids = side(text)
            if b"".join(map(side.bytes.__getitem__, ids)) != wanted:
                return None
            out.append(ids)
        return out[0], out[1]

    def _aligned(self, a: list[int], b: list[int], ends: np.ndarray) -> list[tuple]:
        """Numbers of tokens and groups, groups as text and links, for each stretch that ends at one of ``ends``."""
        ids_a, ids_b = np.array(a), np.array(b)
        size_a, size_b = map(len, self.sizes)
        ends_a, ends_b = np.cumsum(self.sizes[0][ids_a]), np.cumsum(self.sizes[1][ids_b])
        place = np.searchsorted(ends_b, ends_a)
        shared = ends_b[place] == ends_a
        at_a, at_b = np.flatnonzero(shared), place[shared]
        common, stops_a, stops_b = ends_a[at_a], at_a + 1, at_b + 1
        links = (ids_a[at_a] * PAIR + ids_b[at_b]).astype("<i8").tobytes()
        # Tokens in the order of the text of the groups: those of the first tokenizer, then those of the second.
        named = np.empty(len(a) + len(b), np.int64)
        group_a, group_b = np.cumsum(shared) - shared, np.searchsorted(common, ends_b)
        named[np.arange(len(a)) + np.append(0, stops_b)[group_a]] = ids_a + np.where(shared, size_a, 0)
        ends_group = np.zeros(len(b), bool)
        ends_group[at_b] = True
        named[np.arange(len(b)) + stops_a[group_b]] = ids_b + 2 * size_a + np.where(ends_group, size_b, 0)
        text = "".join(map(self.names.__getitem__, named.tolist()))
        text_ends = np.cumsum(self.name_sizes[named])
        last = np.searchsorted(common, ends)
        if (common[last] != ends).any():
            raise ValueError("a token reaches over the end of a segment")
        n_a, n_b, n_groups = (np.diff(stops, prepend=0).tolist() for stops in (stops_a[last], stops_b[last], last + 1))
        cuts = [0, *text_ends[stops_a[last] + stops_b[last] - 1].tolist()]
        groups = [text[i : j - 1] for i, j in zip(cuts, cuts[1:], strict=False)]
        cuts = [0, *((last + 1) * 8).tolist()]
        own = [links[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        return list(zip(n_a, n_b, n_groups, groups, own, strict=True))

    def whole(self, text: str) -> tuple | None:
        """The alignment of a text (with its first blank) tokenised as it is; None where the bytes do not come back."""
        ids = self._ids(text)
        return self._aligned(*ids, np.array([len(text.encode())]))[0] if ids else None

    @staticmethod
    def segments(text: str) -> list:
        """Names of the segments of a blank and the text: what follows a blank; with its line end, what follows one.

        A blank before a line end makes a name of its own kind, a tuple.
        """
        spaced = " " + text
        if not _RUN.search(spaced):
            return spaced.replace("\n", " \n").split(" ")[1:]
        return [s if s[0] == "\n" else (s,) if s[1:2] == "\n" else s[1:] for s in _CUT.split(spaced)]

    @staticmethod
    def _segment(name: str | tuple) -> str:
        return name[0] if isinstance(name, tuple) else name if name[:1] == "\n" else " " + name

    def _learn(self, names: list) -> dict[str | tuple, tuple | None]:
        """Alignments of segments; those of one word many at a time, as one text."""
        found: dict[str | tuple, tuple | None] = {}
        words = [n for n in names if isinstance(n, str) and len(own := n.split()) == 1 and n in (own[0], "\n" + own[0])]
        if words and (ids := self._ids("".join(map(self._segment, words)))):
            ends = np.cumsum([len(self._segment(w).encode()) for w in words])
            found.update(zip(words, self._aligned(*ids, ends), strict=True))
        found.update((n, self.whole(self._segment(n))) for n in names if n not in found)
        return found

    def many(self, batch: list[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, groups, links) of each text."""
        cut = [self.segments(t) if t else [] for t in batch]
        needed = {s for own in cut for s in own}
        if len(self.known) > self.remembered:
            self.known, self.older = {}, self.known  # what is met again stays
        missing = [s for s in needed if s not in self.known]
        self.known.update((s, self.older[s]) for s in missing if s in self.older)
        new = self._learn([s for s in missing if s not in self.known])
        self.known.update((s, entry) for s, entry in new.items() if entry and len(s) <= LONGEST)
        out = []
        for text, own in zip(batch, cut, strict=True):
            parts = list(map(self.known.get, own))
            if None in parts:
                parts = [part or new[s] for s, part in zip(own, parts, strict=True)]
            if not parts or None in parts:
                out.append((self.whole(" " + text) if text else None) or self.NOTHING)
                continue
            n_a, n_b, n_groups, groups, links = zip(*parts, strict=True)
            out.append((sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), b"".join(links)))
        return out


_TEXTS = "array<struct<key: binary, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string>>"
_TEXT_TYPE = pa.list_(pa.struct([("key", pa.binary()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]))


def text_key(text: Column) -> Column:
    """SHA-256 of a text as bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def chunks(docs: DataFrame, first_path: str, second_path: str, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """One row per chunk of distinct texts: its pairs with their numbers, links of all texts, and the texts' measures."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept_in_worker(f"aligner {first_path} {second_path}", lambda: Aligner(first_path, second_path))
        rows, links, times, number = [], [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal number
            codes = np.frombuffer(b"".join(links), "<i8")
            pairs, place = np.unique(codes, return_inverse=True)
            weight = np.repeat(np.array(times, np.int64), [len(x) // 8 for x in links])
            counts = np.zeros(len(pairs), np.int64)
            np.add.at(counts, place, weight)
            values = [(task_block() << 32) + number, packed_sorted(pairs), packed_ints(counts), packed_ints(place), list(rows)]
            for held in (rows, links, times):
                held.clear()
            number += 1
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), _TEXT_TYPE]
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds, strict=True)], ["chunk", "pairs", "counts", "links", "texts"])

        held = 0
        for batch in parts:
            numbers = batch.column(1).to_pylist()
            for at in range(0, len(numbers), 256):
                own = list(texts(batch.slice(at, 256), "text"))
                for text, times_seen, (n_a, n_b, n_groups, groups, linked) in zip(own, numbers[at : at + 256], aligner.many(own), strict=True):
                    digest = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
                    rows.append({"key": hashlib.sha256(text.encode()).digest(), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": len(linked) // 8, "groups_sha256": digest})
                    links.append(linked)
                    times.append(times_seen)
                    held += len(linked) // 8
                    if held >= chunk_links:
                        held = 0
                        yield out()
        if rows:
            yield out()

    counted = docs.where("text != ''").groupBy("text").agg(F.count(F.lit(1)).alias("times"))
    return written(counted.mapInArrow(run, f"chunk bigint, pairs binary, counts binary, links binary, texts {_TEXTS}"), "aligned")[0]


def chunk_pairs(chunked: DataFrame) -> DataFrame:
    """(pair, chunk, n) for each pair of a chunk."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for chunk, pairs, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = unpacked_sorted(pairs).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), chunk)), pa.array(unpacked_ints(counts).astype(np.int64))], ["pair", "chunk", "n"])

    return chunked.select("chunk", "pairs", "counts").mapInArrow(run, "pair bigint, chunk bigint, n bigint")


def pair_counts(chunked: DataFrame) -> DataFrame:
    """(pair, count, best): links of the corpus that hold the pair, and whether no pair of its second id has more."""
    totals, _ = written(chunk_pairs(chunked).groupBy("pair").agg(F.sum("n").alias("count")), "pair_counts")
    second = F.col("pair") % PAIR
    top = totals.groupBy(second.alias("second")).agg(F.max("count").alias("top"))
    return totals.join(top, second == F.col("second")).select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def text_measures(chunked: DataFrame) -> DataFrame:
    """One row per distinct text: key, numbers of tokens, groups and links, best links and the sum of their counts."""
    schema = "key binary, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"

    def run(own: pa.Table, counted: pa.Table) -> pa.Table:
        order = np.argsort(counted.column("pair").to_numpy())
        counts = counted.column("count").to_numpy()[order]
        best = counted.column("best").to_numpy(zero_copy_only=False)[order]
        out = []
        for row in own.select(["links", "texts"]).to_pylist():
            place = unpacked_ints(row["links"]).astype(np.int64)
            sums = np.append(0, np.cumsum(counts[place])).tolist() if len(place) else [0]
            bests = np.append(0, np.cumsum(best[place])).tolist() if len(place) else [0]
            at = 0
            for text in row["texts"]:
                to = at + text["n_links"]
                out.append(text | {"n_best": int(bests[to] - bests[at]), "count_sum": int(sums[to] - sums[at])})
                at = to
        kinds = {"key": pa.binary(), "groups_sha256": pa.string()}
        return pa.Table.from_pylist(out, pa.schema([(c.split()[0], kinds.get(c.split()[0], pa.int64())) for c in schema.split(", ")]))

    answers = chunk_pairs(chunked).join(pair_counts(chunked), "pair").select("chunk", "pair", "count", "best")
    return chunked.select("chunk", "links", "texts").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def align(docs: DataFrame, first_path: str, second_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """One row per document with the measures of its text.

    ``first_path`` is a byte-level tokenizer file, ``second_path`` a sentencepiece
    model; the executors must be able to read both.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    measures = text_measures(chunks(own, first_path, second_path, chunk_links))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    keyed = own.where("text != ''").select("doc_id", text_key(F.col("text")).alias("key")).join(measures, "key")
    plain = own.where("text is null or text = ''").select("doc_id", *[F.lit(0).cast("bigint").alias(c) for c in names], F.lit("").alias("groups_sha256"))
    return keyed.select("doc_id", *names, "groups_sha256").unionAll(plain)
