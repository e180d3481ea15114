import hashlib
import random

import numpy as np

from plumbline.llm import fingerprint
from plumbline.llm.common import mix
from tests.llm.conftest import EDGES

WALKS = fingerprint.Walks()


def brute_print(text):
    """A fingerprint step by step, from the definition of the walks."""
    codes = [ord(c) for c in text]
    walked = []
    for w in range(fingerprint.WALKS):
        steps = []
        for code in codes:
            c = int(mix(np.array([code], np.uint64))[0] >> np.uint64(58))
            stay = WALKS.stays[(w * fingerprint.CLASSES + c) * fingerprint.PERIOD + len(steps) % fingerprint.PERIOD]
            steps += [code] * int(stay)
        walked.append(steps)
    longest = max(map(len, walked))
    out = []
    for k in range(longest.bit_length()):
        for w in range(fingerprint.WALKS):
            before = sum(WALKS.per[:k])
            for s in range(before, before + WALKS.per[k]):
                at = int(WALKS.samples[w][s])
                out.append("." if at >= len(walked[w]) else "%x" % int(mix(np.array([walked[w][at]], np.uint64) + WALKS.salts[w][s])[0] >> np.uint64(60)))
    return "".join(out)


def brute(rows):
    texts = [t or "" for _, t in rows]
    out = []
    for k, (doc_id, _) in enumerate(rows):
        text, after = texts[k], texts[(k + 1) % len(texts)]
        cut = len(text) - len(text) // 2
        edited = text[:cut] + after[: len(text) // 2]
        prints = [np.frombuffer(brute_print(t).encode(), np.uint8) for t in (text, edited, after)]
        near = [WALKS.likeness(prints[0], p) for p in prints[1:]]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), brute_print(text), brute_print(edited), *near))
    return out


def got(result):
    return sorted(map(tuple, result.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()), key=str)


def text_of(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioubcdfgélmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_same_as_walking_step_by_step(spark, make_docs):
    rows = [(i, text_of(i, random.Random(i).randrange(0, 120))) for i in range(0, 400, 2)]
    rows[17] = (rows[17][0], "")
    rows[18] = (rows[18][0], "x")
    rows[30] = (rows[30][0], rows[29][1])
    shuffled = rows[:]
    random.Random(5).shuffle(shuffled)
    for lot in (400, 1_000_000):  # walks alone, and many together
        assert got(fingerprint.fingerprints(make_docs(shuffled).repartition(5), lot_chars=lot)) == sorted(brute(rows), key=str)


def test_edges(spark, make_docs):
    result = fingerprint.fingerprints(make_docs(EDGES)).collect()
    assert len(result) == len(EDGES)
    by_id = {r["doc_id"]: r for r in result}
    assert by_id[2]["fingerprint"] == "" and by_id[1]["near_next"] == 1.0 and by_id[1]["near_edited"] == 1.0
    long = next(t for i, t in EDGES if i == 5)
    assert by_id[5]["edited_sha256"] == hashlib.sha256((long[: len(long) - len(long) // 2] + "same text here"[: len(long) // 2]).encode()).hexdigest()
    assert len({r["fingerprint"] for r in result if r["doc_id"] == 6}) == 1
    assert got(fingerprint.fingerprints(make_docs([(3, "alone here")]))) == brute([(3, "alone here")])
    assert got(fingerprint.fingerprints(make_docs([]))) == []


def test_many_equal_ids_are_spread_and_tied_by_text(spark, make_docs):
    rows = [(7, f"text number {k} {text_of(k, 20)}") for k in range(300)]
    result = got(fingerprint.fingerprints(make_docs(rows)))
    assert len(result) == 300 and len({r[3] for r in result}) == 300


def test_likeness_follows_edits_and_links_find_near_copies(spark, make_docs):
    rng = random.Random(3)
    base = [text_of(k, 300) for k in range(30)]
    rows = []
    for k, text in enumerate(base):
        words = text.split(" ")
        for _ in range(2):
            words[rng.randrange(len(words))] = "zzzz"
        rows += [(3 * k, text), (3 * k + 1, " ".join(words)), (3 * k + 2, text)]
    prints = fingerprint.fingerprints(make_docs(rows))
    by_id = {r["doc_id"]: r for r in prints.collect()}
    edited = [by_id[3 * k]["near_next"] for k in range(30)]
    unlike = [by_id[3 * k + 2]["near_next"] for k in range(29)]
    halves = [r["near_edited"] for r in by_id.values()]
    assert min(edited) > max(unlike) + 0.1 and np.mean(edited) > 0.6
    assert max(unlike) < 0.3 and 0.4 < np.mean(halves) < 0.7
    links = {(r["doc_id"], r["first_id"]) for r in fingerprint.linked(prints, 0.5).collect()}
    assert {(3 * k + 2, 3 * k) for k in range(30)} <= links
    assert all(a // 3 == b // 3 for a, b in links)
    assert sum((3 * k + 1, 3 * k) in links for k in range(30)) >= 24
