import numpy as np

from plumbline.llm import ann as A


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string, q int")


def exact(rows, k=20, every=20):
    fine = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, v in fine:
        if i % every == 0:
            out[i] = sorted(((-float((v * w).sum()), j) for j, w in fine if j != i))[:k]
    return out


def rows_of(n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) + 2 * rng.normal(size=(10, dim))[rng.integers(0, 10, n)]
    return [(k, [float(v) for v in row], 1, "c", 2) for k, row in enumerate(x)]


def test_recall_and_order(spark):
    rows = rows_of(2_000)
    want = exact(rows)
    got = {}
    for r in A.nearest(table(spark, rows).repartition(3), shard_rows=300).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = 0
    scores = {i: {j: -s for s, j in best} for i, best in want.items()}
    for i, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(found, found[1:], strict=False))
        hits += sum(f[1] in scores[i] for f in found)
        assert all(abs(f[2] - scores[i][f[1]]) < 1e-9 for f in found if f[1] in scores[i])
    assert hits >= 0.9 * 20 * len(want)


def test_every_code_within_the_radius_is_retrieved():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (500, 8)).astype(np.uint8)
    codes[250:] = codes[:250] ^ (rng.random((250, 8)) < 0.1)
    shard = A.Shard(np.arange(500), rng.normal(size=(500, 4)), codes)
    for radius in (0, 3, 9, 20, 64):
        for q in range(0, 500, 50):
            distance = np.bitwise_count(codes ^ codes[q]).sum(axis=1)
            assert shard.probe(codes[q], radius).tolist() == np.flatnonzero(distance <= radius).tolist()


def test_long_substrings_retrieve_every_code_within_the_radius():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 256, (5_000, 8)).astype(np.uint8)
    codes[2500:] = codes[:2500] ^ (rng.random((2500, 8)) < 0.1)
    shard = A.Shard(np.arange(5_000), rng.normal(size=(5_000, 4)), codes, 16)
    for radius in (0, 3, 9, 20, 64):
        for q in range(0, 5_000, 500):
            distance = np.bitwise_count(codes ^ codes[q]).sum(axis=1)
            assert shard.probe(codes[q], radius).tolist() == np.flatnonzero(distance <= radius).tolist()


def test_probing_leaves_most_of_a_clustered_table_alone():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(500, 32))
    x = centres[rng.integers(0, 500, 50_000)] + 0.25 * rng.normal(size=(50_000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    model = A.learn(x[:4_000], rows=len(x))
    codes = A.encode(x, model)
    shard = A.Shard(np.arange(len(x)), x, codes, model["width"])
    touched = hits = 0
    for q in range(0, 50_000, 1_000):
        touched += len(shard.retrieve(codes[q], model["radius"]))
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20]) & set(shard.nearest(q, x[q], codes[q], model["radius"], 20)[0].tolist()))
    assert touched < 0.2 * 50 * 50_000
    assert hits >= 0.95 * 50 * 20


def test_edges(spark):
    rows = rows_of(30)
    odd = [(100, None, 1, "c", 2), (120, [], 1, "c", 2), (140, [0.0] * 16, 1, "c", 2), (160, [1.0] * 15 + [None], 1, "c", 2), (180, [1.0] * 15 + [float("nan")], 1, "c", 2), (200, [1.0] * 15 + [float("inf")], 1, "c", 2)]
    ties = [(41, *rows[0][1:]), (40, *rows[0][1:]), (7, *rows[7][1:])]
    every = rows + odd + ties
    got = {}
    for r in A.nearest(table(spark, every), k=50).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    want = exact(every, k=50)
    assert {i: [v for _, v in sorted(f)] for i, f in got.items()} == {i: [j for _, j in best] for i, best in want.items()}
    assert A.nearest(table(spark, [])).count() == 0
    assert A.nearest(table(spark, odd)).count() == 0
