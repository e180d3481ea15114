import random
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import jaccard as J

from .conftest import EDGES, words


def brute(docs, threshold=0.8):
    sets = [(k, i, frozenset(J.shingles(t).tolist())) for k, (i, t) in enumerate(docs)]
    links, root = Counter(), {k: k for k, _, _ in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, _, a in sets:
        for m, _, b in sets[k + 1 :]:
            if a and b and len(a & b) >= threshold * len(a | b):
                links[k] += 1
                links[m] += 1
                root[top(m)] = top(k)
    order = lambda i: (i is None, i)
    name = {}
    for k, i, _ in sets:
        t = top(k)
        if t not in name or order(i) < order(name[t]):
            name[t] = i
    return sorted(((i, name[top(k)], links[k]) for k, i, _ in sets), key=str)


def edited(base, seed, edits):
    rng, out = random.Random(seed), list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10_000)}"
    return " ".join(out)


def documents():
    docs = [(1000 + k, " ".join(words(k, 80, 5_000))) for k in range(60)]
    for g in range(8):
        base = words(500 + g, 150, 5_000)
        docs += [(10 * g + k, edited(base, 100 * g + k, k % 4)) for k in range(8)]
    shared = words(900, 12)
    docs += [(2000 + k, " ".join([*shared, *words(2000 + k, 30, 5_000)])) for k in range(30)]
    return docs + EDGES + [(3000, "two words"), (3001, "Two, WORDS!"), (3002, "one")]


@pytest.mark.parametrize(("leaf", "tile"), [(64, 1_024), (4, 8)])
def test_matches_brute_force(make_docs, leaf, tile):
    docs = documents()
    rows = J.near_duplicates(make_docs(docs).repartition(3), leaf=leaf, tile=tile).collect()
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in rows), key=str)
    want = brute(docs)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    # all links of pairs well above the threshold, and hardly one lost at it
    assert sum(g[2] for g in got) >= 0.98 * sum(w[2] for w in want)
    assert all(g[2] <= w[2] for g, w in zip(got, want, strict=True))


def test_dense_group_of_copies_and_near_copies(make_docs):
    base = words(1, 200, 5_000)
    docs = [(k, edited(base, k, 1)) for k in range(150)] + [(500 + k, " ".join(base)) for k in range(100)]
    rows = J.near_duplicates(make_docs(docs), leaf=8, tile=32).collect()
    assert {r.class_id for r in rows} == {0}
    assert sorted((r.doc_id, r.n_links) for r in rows) == [(i, n) for i, _, n in sorted(brute(docs))]
    assert sum(r.first for r in rows) == 1


def test_pairs_at_the_threshold_meet_on_the_last_level():
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(2_000):
        larger = rng.integers(0, 2**64, 200, dtype=np.uint64)
        for run in range(J.runs_needed(J.RECALL)):
            a, b = J.steps(larger[:160], run, 0.8, J.DEPTH), J.steps(larger, run, 0.8, J.DEPTH)
            if all(set(x) & set(y) for x, y in zip(a, b, strict=True)):
                met += 1
                break
    assert met >= 0.985 * 2_000


def test_dense_groups_at_exactly_the_threshold(make_docs):
    """In each group 65 sets of 200 words hold all 160 words of one set, in nodes too large for brute force above the last level."""
    groups = 60
    docs = []
    for g in range(groups):
        core = [f"g{g}w{k}" for k in range(160)]
        docs.append((100 * g, " ".join(core)))
        docs += [(100 * g + m, " ".join([*core, *(f"g{g}m{m}w{k}" for k in range(40))])) for m in range(1, 66)]
    rows = J.near_duplicates(make_docs(docs), width=1).collect()
    assert all(r.n_links in (0, 1, 65) for r in rows)
    assert sum(r.n_links for r in rows) >= 0.98 * groups * 65 * 2


def test_one_of_each(make_docs):
    docs = documents()
    frame = make_docs(docs)
    kept = J.one_of_each(frame)
    assert kept.columns == frame.columns
    names = Counter(r.doc_id for r in kept.collect())
    want = {i for i, c, _ in brute(docs) if i == c}
    assert set(names) == want | {None} and names[6] == 1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(500, 501)], "rank long, other long")
    roots = {r.rank: r.root for r in J.components(edges).collect()}
    assert set(roots.values()) == {0, 500} and len(roots) == 103


def test_empty_table(make_docs):
    assert J.near_duplicates(make_docs([])).count() == 0
    assert J.one_of_each(make_docs([])).count() == 0


def test_rows_without_words_stay_whatever_else_repeats(spark):
    rows = [(1, ""), (1, ""), (2, "-- !"), (3, "one two three four five six"), (None, None)]
    for more in ([], [(4, "seven eight nine ten eleven")] * 2):
        docs = spark.createDataFrame([(i, t, 7, "m") for i, t in rows + more], "doc_id long, text string, _id long, _mark string")
        kept = J.one_of_each(docs)
        assert kept.columns == docs.columns
        expected = sorted([(1, ""), (1, ""), (2, "-- !"), (3, rows[3][1]), (None, None), *more[:1]], key=str)
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == expected
