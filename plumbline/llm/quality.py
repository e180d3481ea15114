"""Quality classifier from weak labels: expectation-maximisation over heuristic labellers, then a hashed linear scorer.

Labellers vote good, bad or nothing on a text.  Their votes are counted by
pattern (at most 4 ** labellers rows), and expectation-maximisation finds each
labeller's rate of right votes among good and among bad texts and the share of
good texts.  The posterior of a text's pattern is its soft label.  A logistic
scorer over hashed features (byte trigrams and the bucketed measures behind the
votes) is trained on the soft labels of a bounded sample (``sample`` rows,
chosen by hash) and scores every text.

Defined results: a null or empty text gets no votes and the score of the
scorer's bias alone; equal texts get equal scores; columns beside id and text
are ignored, whatever their names; with an empty table nothing is learned and
every score is the prior 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE, bounded_sample, encoded, range_hashes, rolling, slices, texts, word_places

SAMPLE = 3_000
SLOTS = 4_096
KEEP = 0.5
#: Largest share of good texts on which a labeller may vote bad.
FALSE_ALARMS = 0.01

#: Measures of a text, each a share.
MEASURES = ("signs", "upper", "again", "top", "bars", "stops", "lines", "wild", "variety", "short", "pairs")
#: Labellers: name, measure, range that votes good (or None), range that votes bad (or None), least number of words.
LABELLERS = (
    ("noise", "signs", None, (0.08, 9.0), 1),
    ("marked words", "wild", None, (0.30, 9.0), 5),
    ("shouting", "upper", None, (0.40, 9.0), 3),
    ("stutter", "again", None, (0.15, 9.0), 6),
    ("echo", "pairs", (0.60, 9.0), (-1.0, 0.35), 8),
    ("one word", "top", None, (0.30, 9.0), 12),
    ("list", "bars", None, (0.12, 9.0), 3),
    ("same lines", "lines", None, (0.50, 9.0), 25),
    ("sentences", "stops", (0.03, 0.35), (-1.0, 0.004), 25),
    ("vocabulary", "variety", (0.30, 9.0), (-1.0, 0.12), 12),
    ("short words", "short", (0.10, 0.70), (-1.0, 0.03), 25),
    ("calm", "upper", (-1.0, 0.15), None, 8),
)
_BUCKETS = np.array([0.001, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6, 0.8])
_SIGN = np.zeros(256, np.uint8)
_SIGN[[ord(c) for c in "#%&$*|!<>{}[]\\^~=+@_"]] = 1
_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1
_LETTER = np.zeros(256, np.uint8)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_END = np.zeros(256, np.uint8)
_END[[ord(c) for c in ".!?"]] = 1
_WILD = np.zeros(256, np.uint8)
_WILD[[ord(c) for c in "#%&$*!|"]] = 1


def measures(data: bytes) -> tuple[int, np.ndarray]:
    """Number of words and the measures of a text, each a share."""
    starts, ends = word_places(data, SPACE)
    n = len(starts)
    if not n:
        return 0, np.zeros(len(MEASURES))
    raw = np.frombuffer(data, np.uint8)
    visible = int((ends - starts).sum())
    hashes = range_hashes(data, starts, ends)
    letters = max(1, int(_LETTER[raw].sum()))
    counts = np.sort(np.unique(hashes, return_counts=True)[1])
    lone = (ends - starts == 1) & (raw[starts] == ord("|"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return n, np.array(
        [
            _SIGN[raw].sum() / visible,
            _UPPER[raw].sum() / letters,
            (hashes[1:] == hashes[:-1]).sum() / n,
            counts[-1] / n,
            lone.sum() / n,
            _END[raw].sum() / n,
            1 - len(set(lines)) / len(lines),
            _WILD[raw[ends - 1]].sum() / n,
            # distinct words, against the square root law of a long text
            min(1.0, len(counts) / n * max(1.0, n / 200) ** 0.5),
            (ends - starts <= 3).sum() / n,
            len(np.unique(rolling(hashes, 2))) / max(1, n - 1),
        ]
    )


def votes(n: int, values: np.ndarray) -> np.ndarray:
    """1 good, -1 bad, 0 silent, 2 too short to judge, for each labeller."""
    out = np.full(len(LABELLERS), 2, np.int8)
    for k, (_, name, good, bad, least) in enumerate(LABELLERS):
        if n >= least:
            v = values[MEASURES.index(name)]
            out[k] = 1 if good and good[0] <= v <= good[1] else -1 if bad and bad[0] <= v <= bad[1] else 0
    return out


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> dict:
    """How often each labeller votes bad, nothing and good on bad and on good texts, and the share of good texts.

    Expectation-maximisation over vote patterns.  It starts from labellers that
    are mostly right, and none may vote bad on more than ``FALSE_ALARMS`` of the
    good texts; that fixes the meaning of good and bad.  Silence is a vote
    like the others, since most labellers speak up on bad texts only; a text too
    short to judge tells nothing.
    """
    m = patterns.shape[1]
    cast = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, labeller, vote
    rates = np.tile(np.array([[[0.30, 0.60, 0.10]], [[0.02, 0.48, 0.50]]]), (1, m, 1))  # class, labeller, vote
    share = 0.8
    prior = np.array([[[1.0, 1.0, 0.1]], [[0.1, 1.0, 1.0]]])
    for _ in range(rounds):
        p = _posterior(cast, rates, share)
        found = np.stack([np.einsum("p,plv->lv", counts * w, cast) for w in (1 - p, p)]) + prior
        new = found / found.sum(axis=2, keepdims=True)
        new[1, :, 0] = np.minimum(new[1, :, 0], FALSE_ALARMS)
        new[1, :, 1:] *= ((1 - new[1, :, :1]) / new[1, :, 1:].sum(axis=1, keepdims=True))
        new_share = float(((counts * p).sum() + 4) / (counts.sum() + 5))
        done = np.abs(new - rates).max() < 1e-7 and abs(new_share - share) < 1e-7
        rates, share = new, new_share
        if done:
            break
    return {"rates": rates, "share": share}


def _posterior(cast: np.ndarray, rates: np.ndarray, share: float) -> np.ndarray:
    odds = np.einsum("plv,lv->p", cast, np.log(rates[1] / rates[0])) + np.log(share / (1 - share))
    return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def posterior(patterns: np.ndarray, model: dict) -> np.ndarray:
    """Probability of good for rows of votes."""
    cast = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    return _posterior(cast, model["rates"], model["share"])


# ---- scorer ---------------------------------------------------------------


def slots(data: bytes, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the byte trigrams, and of the bucketed measures."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    trigrams = np.empty(0, np.uint32)
    if len(raw) > 2:
        trigrams = (raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA77) + raw[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
    buckets = np.searchsorted(_BUCKETS, values, "right")
    marks = (np.arange(len(values)) * 31 + buckets + 7).astype(np.uint32) * np.uint32(0x27D4EB2F) >> np.uint32(20)
    return trigrams, marks


def features(data: bytes, values: np.ndarray) -> np.ndarray:
    trigrams, marks = slots(data, values)
    x = np.bincount(trigrams, minlength=SLOTS) / max(1, len(trigrams)) * 4
    np.add.at(x, marks, 0.5)
    return x


def train(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.3, ridge: float = 1e-4) -> dict:
    """Logistic weights by AdaGrad on soft labels; both classes weigh the same."""
    balance = np.where(y >= 0.5, 0.5 / max(1e-9, y.sum()), 0.5 / max(1e-9, (1 - y).sum()))
    weights, bias = np.zeros(x.shape[1]), 0.0
    step, bias_step = np.full(x.shape[1], 1e-8), 1e-8
    for _ in range(rounds):
        slope = balance * (y - 1 / (1 + np.exp(-np.clip(x @ weights + bias, -40, 40))))
        gradient = x.T @ slope - ridge * weights
        step += gradient**2
        weights += rate * gradient / np.sqrt(step)
        bias_gradient = slope.sum()
        bias_step += bias_gradient**2
        bias += rate * bias_gradient / np.sqrt(bias_step)
    return {"weights": weights, "bias": bias}


def score(data: bytes, values: np.ndarray, scorer: dict) -> float:
    trigrams, marks = slots(data, values)
    total = scorer["bias"] + 0.5 * scorer["weights"][marks].sum()
    if len(trigrams):
        total += 4 * scorer["weights"][trigrams].mean()
    return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


# ---- on tables ------------------------------------------------------------


def _chosen(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))


def vote_counts(docs: DataFrame) -> DataFrame:
    """(votes, n): how many texts show a pattern of votes; at most 4 ** labellers rows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = [votes(*measures(encoded(t))).tobytes() for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["votes"])

    return _chosen(docs).select("text").mapInArrow(run, "votes binary").groupBy("votes").agg(F.count("*").alias("n"))


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Label model from all documents, scorer from a bounded sample of them."""
    rows = sorted(vote_counts(docs).collect())
    if not rows:
        return {"labels": None, "scorer": {"weights": np.zeros(SLOTS), "bias": 0.0}}
    patterns = np.array([np.frombuffer(r.votes, np.int8) for r in rows])
    model = label_model(patterns, np.array([r.n for r in rows], float))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            out_x, out_y = [], []
            for text in texts(batch, "text"):
                data = encoded(text)
                n, values = measures(data)
                out_x.append(features(data, values).astype("<f4").tobytes())
                out_y.append(float(posterior(votes(n, values)[None], model)[0]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out_x, pa.binary()), pa.array(out_y, pa.float64())], ["key", "x", "y"])

    keyed = _chosen(docs).select(F.xxhash64("doc_id", "text").alias("key"), "text")
    picked = bounded_sample(keyed, sample, "key").mapInArrow(run, "key bigint, x binary, y double").collect()
    picked.sort(key=lambda r: (r.key, r.y))
    x = np.array([np.frombuffer(r.x, "<f4") for r in picked], np.float32)
    return {"labels": model, "scorer": train(x, np.array([r.y for r in picked]))}


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, label, score): posterior of the labellers and the scorer's probability of good."""
    chosen = _chosen(docs)
    kind = chosen.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in parts:
            label, good = [], []
            for text in texts(batch, "text"):
                data = encoded(text)
                n, values = measures(data)
                label.append(0.5 if held["labels"] is None else float(posterior(votes(n, values)[None], held["labels"])[0]))
                good.append(score(data, values, held["scorer"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(label, pa.float64()), pa.array(good, pa.float64())], ["doc_id", "label", "score"])

    return chosen.mapInArrow(run, f"doc_id {kind}, label double, score double")


def good_documents(docs: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """The documents whose score reaches ``keep``, in their own columns.

    Rows go to Python once, and only those that stay come back.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, sample)["scorer"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(parts):
            good = []
            for text in texts(batch, "text"):
                data = encoded(text)
                good.append(score(data, measures(data)[1], sent.value) >= keep)
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    found = scored(docs, fit(docs, sample))
    return found.select("doc_id", "label", "score", (F.col("score") >= keep).alias("keep"))
