import numpy as np
import pytest

from plumbline.llm import quality as Q

from .conftest import EDGES

SF = "/root/testdata/sf0.01"


def test_label_model_finds_planted_rates():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.85
    votes = np.zeros((len(good), 5), np.int8)
    for k, (on_bad, alarm, on_good) in enumerate([(0.7, 0.005, 0.0), (0.5, 0.005, 0.0), (0.6, 0.0, 0.9), (0.4, 0.002, 0.7), (0.3, 0.0, 0.5)]):
        draw = rng.random(len(good))
        votes[good, k] = np.where(draw[good] < alarm, -1, np.where(draw[good] > 1 - on_good, 1, 0))
        votes[~good, k] = np.where(draw[~good] < on_bad, -1, np.where(draw[~good] > 0.95, 1, 0))
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = Q.label_model(patterns, counts.astype(float))
    assert abs(model["share"] - good.mean()) < 0.03
    assert np.abs(model["rates"][0, :, 0] - [0.7, 0.5, 0.6, 0.4, 0.3]).max() < 0.06
    assert ((Q.posterior(patterns, model)[which.ravel()] >= 0.5) == good).mean() > 0.97


def test_separates_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.report(docs).join(labels, "doc_id").collect()
    good = [r.keep for r in rows if r.quality == 1]
    bad = [r.keep for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.97
    assert sum(bad) / len(bad) < 0.2


def test_edges(spark, make_docs):
    rows = Q.report(make_docs(EDGES)).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 and r.keep is not None for r in rows)
    assert len({r.score for r in rows if r.doc_id == 6}) == 1
    assert Q.report(make_docs([])).count() == 0
    kept = Q.good_documents(make_docs(EDGES))
    assert kept.columns == make_docs([]).columns


@pytest.mark.parametrize("text", ["Oh " * 40, "AB!! CD!! EF!! GH!! IJ!! KL!! MN!!", "ab### cd&&& ef%%% gh*** ij$$$"])
def test_labellers_see_junk(text):
    assert (Q.votes(*Q.measures(text.encode())) == -1).any()
