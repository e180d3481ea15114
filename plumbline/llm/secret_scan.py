"""Secret scan: fixed patterns, and a linear-chain conditional random field that adds spans.

Tokens are words between white space.  Each is tagged outside (O), begin (B)
or inside (I) from its own shape, the shapes of its neighbours, the hashed
words before and after it, and features of its file (share of code signs,
length).  The field is trained here: tokens under the fixed patterns are B and
I, all others O, in windows of a bounded sample of documents (``sample`` rows,
chosen by hash) and of a bounded sample of those with a hit, for which all documents
are searched; each hit is also shown with random values that the patterns allow, with
and without its name, and neighbouring words are blanked in half of the
windows, so that shape alone can carry a tag.  Without a single pattern hit in the table
nothing is added.

Decoding is exact Viterbi over the whole text, done only where it can matter:
with M the most that leaving O can gain in transitions, each token whose best
other emission stays more than M below O is O on the best path, and cuts the
text into short stretches that are decoded one by one.

Defined results: a null or empty text has no spans; a tagged stretch that
touches a span of the patterns is dropped, the patterns' span stays; equal
rows get equal results; columns beside id and text are ignored, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import LOWER, bounded_sample, encoded, slices, texts, word_hashes, word_places, written

# The patterns of the base scan.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")

SAMPLE = 4_000
#: Of documents with hits, so many to one of the sample.
HIT_SHARE = 0.25
WINDOW = 24
#: Windows whose weights are looked up at a time.
BLOCK = 1_024
WORD_SLOTS = 4_096
_VALUE = re.compile(r"[A-Za-z0-9+/_.=-]+")


def base_spans(text: str | None, longest: int | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, ends exclusive.

    ``longest`` may give the length of the text's longest word: the last two
    kinds lie inside a word.
    """
    if not text:
        return []
    out = []
    if ":" in text or "=" in text:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if longest is None or longest >= 20:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20] if "AKIA" in text else []
        out += [(*m.span(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# ---- features -------------------------------------------------------------

_CLASSES = np.zeros((5, 256), np.uint8)
_CLASSES[0, 48:58] = 1  # digits
_CLASSES[1, 65:91] = 1  # upper case
_CLASSES[2, 97:123] = 1  # lower case
_CLASSES[3, 128:] = 1  # beyond ASCII
_CLASSES[4, 33:127] = 1 - _CLASSES[0, 33:127] - _CLASSES[1, 33:127] - _CLASSES[2, 33:127]  # signs
_HEX = np.zeros(256, np.uint8)
_HEX[[*range(48, 58), *range(97, 103)]] = 1
_KIND = _CLASSES[0] + 2 * (_CLASSES[1] + _CLASSES[2]) + 3 * _CLASSES[3] + 4 * _CLASSES[4]

#: Number of values of each part of a shape.
SHAPE_PARTS = (6, 4, 3, 3, 2, 4, 2)
SHAPES = int(np.prod(SHAPE_PARTS))
FILE_PARTS = (4, 3)


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


def shapes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The shape number of each word."""
    raw = np.frombuffer(data, np.uint8)
    size = ends - starts
    digits, upper, wide, signs = (_sums(_CLASSES[k][raw], starts, ends) for k in (0, 1, 3, 4))
    hexes = _sums(_HEX[raw], starts, ends)
    kind = _KIND[raw]
    turns = _sums(np.concatenate(([0], (kind[1:] != kind[:-1]).astype(np.uint8))), np.minimum(starts + 1, ends), ends)
    parts = (
        np.searchsorted([4, 8, 16, 24, 40], size, "right"),
        np.where(digits == 0, 0, np.where(digits * 5 < size, 1, np.where(digits * 2 < size, 2, 3))),
        np.where(upper == 0, 0, np.where(upper * 2 < size, 1, 2)),
        np.where(signs == 0, 0, np.where(signs * 5 < size, 1, 2)),
        (hexes + signs == size).astype(np.int64),
        np.searchsorted([1, 4, 10], turns, "right"),
        (wide > 0).astype(np.int64),
    )
    out = np.zeros(len(size), np.int64)
    for part, many in zip(parts, SHAPE_PARTS, strict=True):
        out = out * many + part
    return out


def file_features(data: bytes, words: int) -> np.ndarray:
    code = sum(data.count(c) for c in (b"=", b":", b"{", b"}", b";", b'"'))
    share = code / max(1, len(data))
    return np.array([int(np.searchsorted([0.0005, 0.005, 0.03], share, "right")), int(np.searchsorted([100, 1000], words, "right"))])


def _shape_parts(shape: np.ndarray) -> list[np.ndarray]:
    out = []
    for many in reversed(SHAPE_PARTS):
        out.append(shape % many)
        shape = shape // many
    return out[::-1]


#: Blocks of the weight table: own shape parts, shape before, shape after, words before, two before and after, file.
_PART_STARTS = np.cumsum([0, *SHAPE_PARTS])
N_SHAPE = int(_PART_STARTS[-1])
_BLOCKS = np.cumsum([0, N_SHAPE, N_SHAPE, N_SHAPE, WORD_SLOTS + 1, WORD_SLOTS + 1, WORD_SLOTS + 1, *FILE_PARTS, 1])
N_FEATURES = int(_BLOCKS[-1])


def token_features(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word places, shape numbers, word slots and file features of a text."""
    starts, ends = word_places(data)
    shape = shapes(data, starts, ends)
    slot = (word_hashes(data.translate(LOWER)) % np.uint64(WORD_SLOTS)).astype(np.int64)
    return starts, ends, shape, slot, file_features(data, len(starts))


def _shifted(values: np.ndarray, by: int, fill: int) -> np.ndarray:
    out = np.full(len(values), fill, values.dtype)
    if by > 0:
        out[by:] = values[:-by]
    else:
        out[:by] = values[-by:]
    return out


def feature_rows(shape: np.ndarray, slot: np.ndarray, file: np.ndarray) -> np.ndarray:
    """Numbers of the active weights of each token."""
    columns = []
    none = 0  # the shape of a missing neighbour
    for block, own in ((0, shape), (1, _shifted(shape, 1, none)), (2, _shifted(shape, -1, none))):
        columns += [_BLOCKS[block] + _PART_STARTS[k] + part for k, part in enumerate(_shape_parts(own))]
    for block, by in ((3, 1), (4, 2), (5, -1)):
        columns.append(_BLOCKS[block] + _shifted(slot, by, WORD_SLOTS))
    columns += [np.full(len(shape), _BLOCKS[6 + k] + file[k]) for k in range(2)]
    columns.append(np.full(len(shape), _BLOCKS[8]))
    return np.stack(columns, axis=1)


# ---- training -------------------------------------------------------------

O, B, I = 0, 1, 2  # noqa: E741


def tags(text: str, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """B, I and O of each token under the fixed patterns' values."""
    out = np.zeros(len(starts), np.int64)
    size = int((ends - starts).max()) if len(starts) else 0
    for start, end, kind in base_spans(text, size):
        if kind == "assign":  # the value alone is secret, not its name
            start = ASSIGN.match(text, start).start(2)
        a, b = len(encoded(text[:start])), len(encoded(text[:end]))
        first, last = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b))
        if first < last and not out[first:last].any():
            out[first] = B
            out[first + 1 : last] = I
    return out


_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALPHABETS = (_UPPER + _LOWER + _DIGITS, _UPPER + _LOWER + _DIGITS + "+/_-", _UPPER + _DIGITS, _LOWER + _DIGITS, "0123456789abcdef")


def training_windows(text: str, seed: int, windows: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature rows, tags) of windows around hits and of a few others."""
    data = encoded(text)
    starts, ends, shape, slot, file = token_features(data)
    if not len(starts):
        return
    rows, marked = feature_rows(shape, slot, file), tags(text, data, starts, ends)
    rng = np.random.default_rng(seed)
    hits = np.flatnonzero(marked == B)[:8].tolist()
    spots = [h - int(rng.integers(4, WINDOW - 4)) for h in hits]
    spots += rng.integers(0, max(1, len(rows) - WINDOW) + 1, windows).tolist()
    strange = np.flatnonzero((ends - starts >= 16) & (marked == O))[:2]
    spots += [int(s) - WINDOW // 2 for s in strange]
    for at in spots:
        at = max(0, at)
        yield rows[at : at + WINDOW], marked[at : at + WINDOW]
    for h in hits:
        # the same place with a value drawn from the alphabet that the patterns allow, with and without its name
        a, b = max(0, h - WINDOW // 2), min(len(starts), h + WINDOW // 2)
        words = [data[starts[k] : ends[k]] for k in range(a, b)]
        for named in (True, False):
            letters = _ALPHABETS[int(rng.integers(len(_ALPHABETS)))]
            value = "".join(rng.choice(list(letters), int(rng.integers(20, 49)))).encode()
            before = words[: h - a] if named else words[: max(0, h - a - 2)]
            _, _, own, own_slot, _ = token_features(b" ".join([*before, value, *words[h - a + 1 :]]))
            label = np.zeros(len(own), np.int64)
            label[len(before)] = B
            yield feature_rows(own, own_slot, file)[:WINDOW], label[:WINDOW]


def train(features: np.ndarray, labels: np.ndarray, sizes: np.ndarray, rounds: int = 50, rate: float = 0.5, ridge: float = 1e-5, seed: int = 3) -> dict:
    """Maximum likelihood of the tag chains by AdaGrad; O has the emission 0."""
    rng = np.random.default_rng(seed)
    n, width, _ = features.shape
    inside = np.arange(width)[None, :] < sizes[:, None]
    weights, step = np.zeros((N_FEATURES + 1, 3)), np.full((N_FEATURES + 1, 3), 1e-6)
    moves, moves_step = np.zeros((3, 3)), np.full((3, 3), 1e-6)
    gold = np.eye(3)[labels] * inside[:, :, None]
    pairs = np.zeros((3, 3))
    for a, b, ok in zip(labels[:, :-1].ravel(), labels[:, 1:].ravel(), inside[:, 1:].ravel(), strict=True):
        pairs[a, b] += ok
    for _ in range(rounds):
        hidden = rng.random(n) < 0.5
        emission = np.empty((n, width, 3))
        for at in range(0, n, BLOCK):
            emission[at : at + BLOCK] = weights[_used(features, hidden, at)].sum(axis=2)
        alpha, beta = np.zeros((n, width, 3)), np.zeros((n, width, 3))
        alpha[:, 0] = emission[:, 0]
        for t in range(1, width):
            new = _logsum(alpha[:, t - 1, :, None] + moves[None], 1) + emission[:, t]
            alpha[:, t] = np.where(inside[:, t, None], new, alpha[:, t - 1])
        for t in range(width - 2, -1, -1):
            new = _logsum(moves[None] + (emission[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(inside[:, t + 1, None], new, 0.0)
        total = _logsum(alpha[:, -1], 1)
        marginal = np.exp(alpha + beta - total[:, None, None]) * inside[:, :, None]
        slope = (gold - marginal) / n
        expected = np.zeros((3, 3))
        for t in range(1, width):
            joint = alpha[:, t - 1, :, None] + moves[None] + (emission[:, t] + beta[:, t])[:, None, :] - total[:, None, None]
            expected += (np.exp(joint) * inside[:, t, None, None]).sum(axis=0)
        gradient = np.zeros_like(weights)
        for at in range(0, n, BLOCK):
            used = _used(features, hidden, at)
            for y in range(1, 3):
                own = np.repeat(slope[at : at + BLOCK, :, y].ravel(), used.shape[2])
                gradient[:, y] += np.bincount(used.ravel(), own, N_FEATURES + 1)
        gradient -= ridge * weights
        gradient[N_FEATURES] = 0
        step += gradient**2
        weights += rate * gradient / np.sqrt(step)
        move_gradient = (pairs - expected) / n - ridge * moves
        moves_step += move_gradient**2
        moves += rate * move_gradient / np.sqrt(moves_step)
    return {"weights": weights[:, 1:], "moves": moves}


def _used(features: np.ndarray, hidden: np.ndarray, at: int) -> np.ndarray:
    """Features of a block of windows; the hidden ones do without neighbouring words."""
    own = features[at : at + BLOCK].copy()
    own[hidden[at : at + BLOCK], :, 21:24] = N_FEATURES
    return own


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


# ---- decoding -------------------------------------------------------------


def decoder(model: dict) -> dict:
    """Weights summed into one table per shape, for its three roles."""
    w, moves = model["weights"], model["moves"]
    every = _shape_parts(np.arange(SHAPES))
    tables = [sum(w[_BLOCKS[b] + _PART_STARTS[k] + part] for k, part in enumerate(every)) for b in range(3)]
    words = [w[_BLOCKS[b] : _BLOCKS[b] + WORD_SLOTS + 1] for b in (3, 4, 5)]
    files = [w[_BLOCKS[6 + k] : _BLOCKS[6 + k] + many] for k, many in enumerate(FILE_PARTS)]
    gain = max(moves[a, y] + moves[y, b] - moves[a, O] - moves[O, b] for a in range(3) for y in (B, I) for b in range(3))
    ends = max(moves[a, y] - moves[a, O] for a in range(3) for y in (B, I)), max(moves[y, b] - moves[O, b] for y in (B, I) for b in range(3))
    return {"shape": tables, "word": words, "file": files, "bias": w[_BLOCKS[8]], "moves": moves, "gain": max(0.0, gain, *ends)}


def viterbi(emission: np.ndarray, moves: np.ndarray, before: bool, after: bool) -> list[int]:
    """Best tags of a stretch; ``before`` and ``after`` say whether an O stands there."""
    score = emission[0] + (moves[O] if before else 0.0)
    back = []
    for row in emission[1:]:
        ways = score[:, None] + moves
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0) + row
    if after:
        score = score + moves[:, O]
    path = [int(score.argmax())]
    for best in reversed(back):
        path.append(int(best[path[-1]]))
    return path[::-1]


def tagged(shape: np.ndarray, slot: np.ndarray, file: np.ndarray, d: dict) -> list[tuple[int, int]]:
    """Token ranges of the secrets on the best path."""
    n = len(shape)
    if not n:
        return []
    score = d["shape"][0][shape] + d["bias"] + d["file"][0][file[0]] + d["file"][1][file[1]]
    score += d["shape"][1][_shifted(shape, 1, 0)] + d["shape"][2][_shifted(shape, -1, 0)]
    for words, by in zip(d["word"], (1, 2, -1), strict=True):
        score += words[_shifted(slot, by, WORD_SLOTS)]
    open_ = np.concatenate(([0], (score.max(axis=1) + d["gain"] >= 0).astype(np.int8), [0]))
    edges = np.diff(open_)
    out: list[tuple[int, int]] = []
    for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
        emission = np.concatenate((np.zeros((b - a, 1)), score[a:b]), axis=1)
        held = None
        for k, tag in enumerate([*viterbi(emission, d["moves"], a > 0, b < n), O]):
            if held is not None and tag != I:
                out.append((held, a + k))
                held = None
            if tag == B or (tag == I and held is None):
                held = a + k
    return out


def _longest_value(text: str) -> tuple[int, int] | None:
    return max((m.span() for m in _VALUE.finditer(text)), key=lambda s: s[1] - s[0], default=None)


def spans(text: str | None, d: dict | None) -> list[tuple[int, int, str]]:
    """All spans of a text, in code points, by start and kind."""
    data = encoded(text)
    if not data:
        return []
    if d is None:
        return base_spans(text)
    starts, ends, shape, slot, file = token_features(data)
    if not len(starts):
        return []
    base = base_spans(text, int((ends - starts).max()))
    out = list(base)
    for first, last in tagged(shape, slot, file, d):
        piece = [data[starts[k] : ends[k]].decode("utf-8", "surrogatepass") for k in (first, last - 1)]
        head, tail = _longest_value(piece[0]), _longest_value(piece[1])
        if head is None or tail is None:
            continue
        start = len(data[: starts[first]].decode("utf-8", "surrogatepass")) + head[0]
        end = len(data[: starts[last - 1]].decode("utf-8", "surrogatepass")) + tail[1]
        if start < end and not any(a < end and start < b for a, b, _ in base):
            out.append((start, end, "crf"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# ---- on tables ------------------------------------------------------------


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> dict | None:
    """Train the field on windows of bounded samples of all documents and of those with a hit; None if no document has one."""
    chosen = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            rows, marks, keys = [], [], []
            for key, text in zip(batch.column("key").to_pylist(), texts(batch, "text"), strict=True):
                for features, own in training_windows(text or "", key & 0x7FFFFFFF):
                    rows.append(features.astype("<i4").tobytes())
                    marks.append(own.astype(np.uint8).tobytes())
                    keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rows, pa.binary()), pa.array(marks, pa.binary())], ["key", "features", "tags"])

    def hit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = [key for key, text in zip(batch.column("key").to_pylist(), texts(batch, "text"), strict=True) if base_spans(text)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["key"])

    hits, _ = written(chosen.mapInArrow(hit, "key bigint").distinct(), "hits")
    own = bounded_sample(chosen, sample, "key")
    # at most twice the share's rows
    more = chosen.join(F.broadcast(bounded_sample(hits, max(1, int(sample * HIT_SHARE)), "key")), "key", "left_semi")
    more = more.join(F.broadcast(own.select("key")), "key", "left_anti").dropDuplicates(["key"])
    windows = own.unionByName(more).mapInArrow(cut, "key bigint, features binary, tags binary").collect()
    windows.sort(key=lambda r: (r.key, bytes(r.features)))
    if not any(B in r.tags for r in windows):
        return None
    columns = len(feature_rows(np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(2, np.int64))[0])
    features = np.full((len(windows), WINDOW, columns), N_FEATURES, np.int32)
    labels, sizes = np.zeros((len(windows), WINDOW), np.int64), np.zeros(len(windows), np.int64)
    for k, r in enumerate(windows):
        sizes[k] = len(r.tags)
        features[k, : sizes[k]] = np.frombuffer(r.features, "<i4").reshape(-1, columns)
        labels[k, : sizes[k]] = np.frombuffer(r.tags, np.uint8)
    windows.clear()
    return decoder(train(features, labels, sizes))


_SPANS = "spans array<struct<start:int,end:int,kind:string>>"


def scan(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, spans) for each document; ``keep_text`` also returns the text."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = [[{"start": a, "end": b, "kind": k} for a, b, k in spans(text, held.value)] for text in texts(batch, "text")]
            columns = {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "spans": pa.array(found, span)}
            if not keep_text:
                del columns["text"]
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return chosen.mapInArrow(run, f"doc_id {kind}, " + ("text string, " if keep_text else "") + _SPANS)


def without(text: str | None, found: list[tuple[int, int, str]], mark: str) -> str | None:
    """A text with ``mark`` in place of its spans; spans that overlap share one."""
    if not found:
        return text
    out, at = [], 0
    for start, end, _ in found:
        if end > at:
            if start >= at:
                out += [text[at:start], mark]
            at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, sample: int = SAMPLE, mark: str = "[SECRET]") -> DataFrame:
    """The documents in their own columns, each secret replaced by ``mark`` and ``n_chars`` set anew."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(parts):
            new, sizes = {}, {}
            for k, text in enumerate(texts(batch, "text")):
                if found := spans(text, held.value):
                    new[k] = without(text, found, mark)
                    sizes[k] = len(new[k])
            if new:
                batch = _replaced(batch, "text", new)
                if "n_chars" in batch.schema.names:
                    batch = _replaced(batch, "n_chars", sizes)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def _replaced(batch: pa.RecordBatch, name: str, values: dict[int, object]) -> pa.RecordBatch:
    """The batch with new values at some rows of a column."""
    at = batch.schema.names.index(name)
    column = batch.column(at)
    mask = np.zeros(batch.num_rows, bool)
    mask[list(values)] = True
    own = pa.array([values[k] for k in sorted(values)], column.type)
    return batch.set_column(at, name, pc.replace_with_mask(column, pa.array(mask), own))


def report(found: DataFrame) -> DataFrame:
    """Digest columns of ``scan``."""

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    text = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    base = F.transform(F.filter("spans", lambda s: s["kind"] != "crf"), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select(
        "doc_id",
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(text, ",").alias("spans"),
        number("crf").alias("n_added"),
    )
