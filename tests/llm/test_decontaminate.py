import hashlib
import re

import pytest

from plumbline.llm import decontaminate as D

from .conftest import EDGES, words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def cut(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n=10):
    out = []
    for doc, text in docs:
        own, hit, names = cut(text), set(), set()
        for item, body in items:
            w = cut(body)
            size = min(n, len(w))
            for a in range(len(w) - size + 1 if w else 0):
                for b in range(len(own) - size + 1):
                    if own[b : b + size] == w[a : a + size]:
                        hit |= set(range(b, b + size))
                        if item is not None:
                            names.add(str(item))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc, len(own), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def cases():
    bench = words(5, 40)
    items = [(1, " ".join(bench)), (2, "Short ITEM"), (2, " ".join(bench[:12])), (3, None), (4, "--- !!"), (None, "nameless passage of words"), (10, " ".join(bench[3:25]))]
    docs = EDGES[:4] + EDGES[5:] + [
        (20, "pre " + " ".join(bench[:10]) + " post"),
        (21, "pre " + ", ".join(bench[5:14]) + " post"),
        (22, "a SHORT-item. b short item c"),
        (23, "x nameless passage of words y"),
        (24, " ".join(bench + bench)),
    ]
    return docs, items


def test_matches_brute_force(spark, make_docs, cases):
    docs, items = cases
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.report(D.contamination(make_docs(docs), bench)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_blocks_give_the_same(spark, make_docs, cases):
    docs, items = cases
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.report(D.contamination(make_docs(docs), bench, block_bytes=2_000)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_remove(spark, make_docs, cases):
    docs, items = cases
    bench = spark.createDataFrame(items, "item_id long, text string")
    hit = {r[0] for r in brute(docs, items) if r[5]}
    source = make_docs(docs)
    whole = D.decontaminate(source, bench)
    assert whole.columns == source.columns
    assert sorted(str(r.doc_id) for r in whole.collect()) == sorted(str(i) for i, _ in docs if i not in hit)
    left = {r.doc_id: r for r in D.decontaminate(source, bench, remove="span").collect()}
    assert left[20].text == "pre  post" and left[20].n_chars == 9
    assert left[21].text == dict(docs)[21]
    assert left[22].text == "a . b  c"


def test_empty_tables(spark, make_docs, cases):
    docs, items = cases
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert D.report(D.contamination(make_docs([]), bench)).count() == 0
    clean = D.report(D.contamination(make_docs(docs), bench.limit(0))).collect()
    assert len(clean) == len(docs) and not any(r.contaminated for r in clean)
