import collections
import math
import re
import zlib

import numpy as np

from plumbline.llm import toxicity as T

from .conftest import EDGES, words


def test_index_finds_the_exact_neighbours():
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(500):
        names = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        weights = rng.random(len(names)) + 0.1
        vectors.append((names, weights / np.linalg.norm(weights)))
    ids = rng.permutation(500).tolist()
    index = T.Index(ids, [i % 2 for i in ids], vectors, 40)
    dense = np.zeros((500, 40))
    for k, (names, weights) in enumerate(vectors):
        dense[k, names] = weights
    for k in range(0, 500, 7):
        places, scores = index.nearest(*vectors[k], 15, ids[k])
        score = dense @ dense[k]
        want = [i for i in np.lexsort((ids, -np.round(score, 12))) if ids[i] != ids[k] and score[i] > 0][:15]
        assert index.ids[places].tolist() == [ids[i] for i in want]
        assert np.allclose(scores, score[want])


def test_index_with_columns_and_postings(monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 16)
    monkeypatch.setattr(T, "COMMON_SHARE", 16)
    monkeypatch.setattr(T, "COMMON", 5)
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(400):
        names = np.unique((200 * rng.random(rng.integers(1, 20)) ** 3).astype(int))
        weights = rng.random(len(names)) + 0.1
        vectors.append((names, weights / np.linalg.norm(weights)))
    index = T.Index(list(range(400)), [0] * 400, vectors, 200)
    assert 0 < len(index.dense) <= 5
    dense = np.zeros((400, 200))
    for k, (names, weights) in enumerate(vectors):
        dense[k, names] = weights
    for k, (places, scores) in enumerate(index.nearest_each(vectors, 7, list(range(400)))):
        score = dense @ dense[k]
        want = [i for i in np.lexsort((np.arange(400), -np.round(score, 12))) if i != k and score[i] > 0][:7]
        assert index.ids[places].tolist() == want and np.allclose(scores, score[want])


def bag(text):
    """Words and their beginnings, as words of a text."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    out = collections.Counter()
    for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low):
        out[w] += 1
        for k in (4, 5, 6):
            if len(w.encode()) > k:
                out[w.encode()[:k], "beginning"] += 1
    return out


def brute_neighbours(docs, labels, k=15):
    """Ids, classes and similarities of the examples next to each document, all compared."""
    train = {i: t for i, t in labels if zlib.crc32(str(i).encode()) % 5}
    bags = {i: bag(text) for i, text in docs}
    held, toxic = collections.Counter(), collections.Counter()
    for i, t in train.items():
        held.update(set(bags[i]))
        toxic.update(set(bags[i]) if t else ())
    n, base = len(train), sum(train.values()) / len(train)

    def weight(term):
        if not held[term]:
            return T.FLOOR * (math.log(n + 1) + 0.1)
        p, m, z = toxic[term] / held[term], held[term], T.Z
        low = (p + z * z / (2 * m) - z * math.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
        tell = min(max(2 * (low - base) / (1 - base), 0), 1)
        return (math.log((n + 1) / held[term]) + 0.1) * (T.FLOOR + (1 - T.FLOOR) * tell)

    vectors = {i: {w: (1 + math.log(c)) * weight(w) for w, c in b.items()} for i, b in bags.items()}
    size = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vectors.items()}
    out = {}
    for i, v in vectors.items():
        like = [(-round(sum(x * vectors[j].get(w, 0) for w, x in v.items()) / size[i] / size[j], 10), j) for j in train if size[i] and size[j]]
        out[i] = [(j, train[j], -s) for s, j in sorted(like) if s < 0][:k]
    return out


def planted(n):
    docs, labels = [], []
    for k in range(n):
        toxic = k % 6 == 0
        text = words(k, 25, 300) + (["Grumbal" + "abcdefgh"[k % 7], "xorvost"] if toxic else [])
        docs.append((k + 1, " ".join(sorted(text, key=lambda w: zlib.crc32((w + str(k)).encode())))))
        labels.append((k + 1, int(toxic)))
    return docs, labels


def test_whole_query_by_brute_force(spark, make_docs):
    docs, labels = planted(240)
    want = brute_neighbours(docs, labels)
    model = T.fit(make_docs(docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = {r.doc_id: r for r in T.scored(make_docs(docs), model).collect()}
    base = model["prior"]
    assert len(rows) == len(docs)
    for i, near in want.items():
        got = rows[i].evidence
        assert [(e.doc_id, e.toxic) for e in got] == [(j, t) for j, t, _ in near[:5]]
        assert all(abs(e.similarity - s) < 1e-9 for e, (_, _, s) in zip(got, near, strict=False))
        votes = [(1 / (1 - min(s, 1) + T.NEAR), t) for _, t, s in near]
        vote = (sum(w * t for w, t in votes) + 0.5 * base) / (sum(w for w, _ in votes) + 0.5)
        assert abs(rows[i].score - np.interp(vote, *model["steps"])) < 1e-6


def test_copies_of_toxic_texts_with_words_of_their_own(spark, make_docs):
    docs, labels = [], []
    for k in range(1, 301):
        toxic = k % 5 == 3
        docs.append((k, " ".join(words(k, 60) if not toxic else [f"r{k}x{n}" for n in range(40)] + words(k, 10))))
        labels.append((k, int(toxic)))
    learnt = [i for i, t in labels if t and zlib.crc32(str(i).encode()) % 5]
    copies = [(1000 + i, docs[i - 1][1]) for i in learnt]
    clean = [(2000 + k, " ".join(words(2000 + k, 60))) for k in range(50)]
    model = T.fit(make_docs(docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = {r.doc_id: r for r in T.scored(make_docs(docs + copies + clean), model).collect()}
    assert all(rows[i].predicted and rows[i].evidence[0].doc_id == i - 1000 for i, _ in copies)
    assert all(rows[i].predicted for i in learnt)
    assert not any(rows[i].predicted for i, _ in clean)


def test_samples_by_class_and_by_terms(spark, make_docs):
    docs, labels = planted(600)
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    train = [t for i, t in labels if zlib.crc32(str(i).encode()) % 5]
    one, stands = T._examples(make_docs(docs), frame, 120)
    sizes = {r.toxic: r["count"] for r in one.groupBy("toxic").count().collect()}
    # toxic ones are not crowded out, and each stands for the rows that were left out
    assert sizes[1] >= 40 and sizes[0] >= 35 and sum(sizes.values()) <= 170
    assert abs(sizes[0] * stands[0] - train.count(0)) < 0.35 * train.count(0)
    model = T.fit(make_docs(docs), frame, sample=120)
    rows = T.scored(make_docs(docs), model).collect()
    assert sum(r.predicted == labels[r.doc_id - 1][1] for r in rows) >= 590
    bare = T.fit(make_docs(docs), frame, entries=2_000)
    index = T.index_of(bare)
    assert 1_900 < len(index.weight) + np.count_nonzero(index.dense) <= 2_000


def test_near_copies_count_once_when_their_shingles_agree(spark, make_docs):
    text = words(5, 100)
    docs = [(k, " ".join(text[:90] + [f"e{k}"])) for k in range(1, 20)]
    # the same first shingle is not enough
    docs += [(k, " ".join(text[:12] + words(k, 80, 5_000))) for k in range(20, 40)]
    frame = spark.createDataFrame([(k, 1) for k, _ in docs], "doc_id long, toxic int")
    one, _ = T._examples(make_docs(docs), frame, 1_000)
    ids = sorted(r.doc_id for r in one.collect())
    held = [k for k, _ in docs if zlib.crc32(str(k).encode()) % 5]
    assert [k for k in ids if k >= 20] == [k for k in held if k >= 20]
    assert len([k for k in ids if k < 20]) < 4


def test_isotonic_rises():
    x = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6])
    tops, rates = T.isotonic(x, np.array([0, 0, 1, 0, 1, 1.0]))
    assert (np.diff(rates) >= 0).all() and rates[0] < 0.5 < rates[-1] and tops[-1] == 0.6


def test_held_out_documents(spark, make_docs):
    docs, labels = list(EDGES), [(1, 0, 0), (2, 1, 1), (None, 1, 1), (4, 1, None)]
    for k in range(400):
        toxic = k % 8 == 0
        text = words(k, 60) + (["grumbal" + "abcdefgh"[k % 7], "xorvost"] if toxic else [])
        docs.append((100 + k, " ".join(sorted(text, key=lambda w: zlib.crc32((w + str(k)).encode())))))
        labels.append((100 + k, 1, int(toxic)))
    # a family of near copies with words of their own does not make these words toxic
    docs += [(1000 + k, " ".join(words(77, 80, 10_000)) + f" xorvost end{k}") for k in range(40)]
    labels += [(1000 + k, 1, 1) for k in range(40)]
    docs.append((5000, " ".join(words(77, 20, 10_000))))
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = T.scored(make_docs(docs), T.fit(make_docs(docs), frame)).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    truth = {i: t for i, _, t in labels if t is not None and i is not None and i >= 100}
    for r in rows:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
        if r.doc_id in truth:
            assert r.predicted == truth[r.doc_id], r
            if r.predicted:
                assert r.evidence and all(e.doc_id % 1 == 0 and 0 < e.similarity <= 1 + 1e-9 for e in r.evidence)
    assert next(r for r in rows if r.doc_id == 5000).predicted == 0


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = T.scored(make_docs(EDGES), T.fit(make_docs(EDGES), none)).collect()
    assert len(rows) == len(EDGES) and not any(r.predicted and r.evidence for r in rows)
    assert T.scored(make_docs([]), T.fit(make_docs([]), none)).count() == 0
