import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from plumbline.llm import hpylm as H

from .conftest import EDGES, words


def expected_tables(c, fresh, d):
    """Mean number of tables over all partitions of c customers, each weighed by its probability."""
    total = mean = 0.0
    for seats in product(range(c), repeat=c):
        if all(s <= max(seats[:k], default=-1) + 1 for k, s in enumerate(seats)):
            sizes = Counter(seats).values()
            weight = fresh ** len(sizes) * math.prod(math.prod(j - d for j in range(1, n)) for n in sizes)
            total, mean = total + weight, mean + weight * len(sizes)
    return mean / total


@pytest.mark.parametrize(("c", "fresh", "d"), [(2, 0.7, 0.5), (4, 0.3, 0.8), (5, 2.0, 0.3)])
def test_gibbs_seating_has_the_right_distribution(c, fresh, d):
    n = 20_000
    tables = H.seated(np.full(n, c), np.full(n, fresh), d, np.random.default_rng(1), keep=3, burn_in=8)
    assert tables.min() >= 1 and tables.max() <= c
    assert abs(tables[-1].mean() - expected_tables(c, fresh, d)) < 0.03


def test_seating_of_none_one_and_crowds():
    counts = np.array([0, 1, 1, 3, 2_000])
    tables = H.seated(counts, np.full(5, 0.1), 0.6, np.random.default_rng(2), keep=2)
    assert (tables[:, :3] == [0, 1, 1]).all() and (tables[:, 3:] >= 1).all() and (tables <= counts).all()


@pytest.mark.parametrize(("c", "fresh", "d"), [(10_000, 20.0, 0.8), (10_000, 160.0, 0.8), (20_000, 3.0, 0.4), (1_500, 1e6, 0.5)])
def test_large_groups_are_seated_whole(c, fresh, d):
    """Numbers of tables against the weights of seating customer by customer."""
    most = min(c, 1_500)
    number = np.arange(most + 1)
    logs = np.full(most + 1, -np.inf)
    logs[0] = 0.0
    with np.errstate(divide="ignore"):
        for n in range(c):
            joins = logs + np.log(np.maximum(n - d * number, 0))
            joins[1:] = np.logaddexp(joins[1:], logs[:-1])
            joins[0] = -np.inf
            logs = joins
    chance = logs + math.log(fresh) * number
    chance = np.exp(chance - chance.max())
    chance /= chance.sum()
    mean = chance @ number
    spread = math.sqrt(chance @ (number - mean) ** 2)
    (tables,) = H.seated(np.full(400, c), np.full(400, fresh), d, np.random.default_rng(6))
    assert abs(tables.mean() - mean) < 4 * spread / 20
    assert spread < 0.2 or abs(tables.std() / spread - 1) < 0.2


def test_weights_of_large_groups():
    """The integral against the recursion over customers."""
    c = H.EXACT
    t = np.arange(1, c - 63)
    for d in (0.05, 0.5, 0.95):
        off = H._large(c, t, d) - H._table_rows(d)[c, 1 : c - 63]
        assert np.ptp(off) < 1e-6
        assert np.abs(H._near_full(c, 100, d)[::-1] - H._table_rows(d)[c, -101:]).max() < 1e-9


def test_probabilities_add_up():
    """Over all words and the unknown one, a context's probabilities are 1."""
    rng = np.random.default_rng(3)
    codes = np.unique((rng.integers(0, 50, 400) << H.CLASS_BITS) | rng.integers(0, 6, 400))
    cells = {"word": codes >> H.CLASS_BITS, "class": codes & (H.CLASSES - 1), "count": rng.integers(1, 9, len(codes)), "words": 50}
    tables = np.bincount(cells["class"], minlength=H.CLASSES)
    model = {"V": 50, "discount": 0.6, "root_discount": 0.4, "tables": tables, "root_customers": float(len(codes)), "root_tables": 50.0}
    (sample,) = H.cell_samples(cells, model, 1, 1)
    customers = np.bincount(cells["class"], cells["count"], H.CLASSES)
    seated = np.bincount(cells["class"], sample["tables"], H.CLASSES)
    parent = H._parent(sample["served"], sample["tops"], sample["served"].sum(), sample["tops"].sum(), 0.4, 1 / 51)
    unknown = H._parent(np.zeros(1), np.zeros(1), sample["served"].sum(), sample["tops"].sum(), 0.4, 1 / 51)[0]
    assert abs(parent.sum() + unknown - 1) < 1e-9
    for u in range(6):
        own = cells["class"] == u
        back = H.STRENGTH + 0.6 * seated[u]
        total = (cells["count"][own] - 0.6 * sample["tables"][own]).sum() + back * (parent.sum() + unknown)
        assert abs(total / (H.STRENGTH + customers[u]) - 1) < 1e-9


def test_production_settings_reach_the_long_run():
    """Pairs and parent seated from scratch, against a long chain."""
    cells = {"word": np.array([0, 0, 1, 2]), "class": np.array([0, 1, 1, 0]), "count": np.array([900, 60, 30, 3]), "words": 3}
    model = {"V": 500, "discount": 0.6, "root_discount": 0.4, "tables": np.array([3_000, 900]), "root_customers": 6_000.0, "root_tables": 500.0}
    long = [s["tables"] for s in H.cell_samples(cells, model, 1, 2_000, burn_in=200)]
    short = []
    for seed in range(2, 502):
        state = dict(cells)
        for turn in range(H.ROUNDS + 1):
            (sample,) = H.cell_samples(state, model, [seed, turn], 1)
            state |= {c: sample[c] for c in ("served", "tops")}
        short.append(sample["tables"])
    off = np.abs(np.mean(short, axis=0) - np.mean(long, axis=0))
    assert (off <= 0.1 * np.mean(long, axis=0)).all(), (np.mean(short, axis=0), np.mean(long, axis=0))


def test_scores(make_docs):
    topics = [[f"t{k}x{j}" for j in range(30)] for k in range(5)]
    rng = np.random.default_rng(4)
    docs = EDGES + [(100 + k, " ".join(rng.choice(topics[k % 5], 60))) for k in range(300)]
    rows = H.score(make_docs(docs).repartition(4)).collect()
    assert len(rows) == len(docs)

    def held(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1

    def tokens(t):
        return [*(t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split(), None]

    counts = Counter(w for i, t in docs if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    texts = dict(docs)
    for r in rows:
        own = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(r.doc_id), len(own), n)
        assert r.n_known == sum(counts[w] > 0 for w in own)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel=1e-9)
        assert r.score < 0
    assert len({(r.score, r.base_score) for r in rows if r.doc_id == 6}) == 1
    new = [r for r in rows if r.held_out and (r.doc_id or 0) >= 100]
    # a topic's words follow each other: better by far than words alone
    assert sum(r.score for r in new) > 0.8 * sum(r.base_score for r in new)


def test_empty_and_untrained(make_docs):
    assert H.score(make_docs([])).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (row,) = H.score(make_docs([(only, "never seen")])).collect()
    assert row.train_tokens == 0 and row.n_known == 0 and row.score == pytest.approx(0.0, abs=1e-6)
