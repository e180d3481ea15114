import hashlib
import re

from plumbline.llm import substring as S

from .conftest import EDGES, words


def brute(docs, width=13):
    cut = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in docs]
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, w in cut:
        for a in range(len(w) - width + 1):
            g = tuple(w[a : a + width])
            first[g] = min(first.get(g, float("inf")), order(i))
    out = []
    for i, w in cut:
        gone = set()
        for a in range(len(w) - width + 1):
            if first[tuple(w[a : a + width])] < order(i):
                gone |= set(range(a, a + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def documents():
    passage, other = words(1, 40), words(2, 30)
    docs = [(50 + k, " ".join([*words(10 + k, 25), *passage, *words(40 + k, 5 * k)])) for k in range(12)]
    docs += [(30, " ".join(passage[:20] + other)), (31, " ".join(passage[5:30] + other[8:])), (32, " ".join(passage[:12])), (33, " ".join(other[10:22])), (34, "\t".join(other[10:23]) + "\x0b")]
    docs += [(40, "la " * 60), (41, "la " * 30), (70, " ".join(words(3, 50))), (70, " ".join(words(3, 50))), (71, " ".join(words(3, 50))), (None, " ".join(words(3, 50)))]
    docs += [(-5, " ".join(words(4, 30))), (-9, " ".join(words(4, 30)))]
    return docs + EDGES[:4] + EDGES[5:]


def test_matches_brute_force(make_docs):
    docs = documents()
    got = S.report(S.repeated(make_docs(docs).repartition(3)))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs)


def test_small_blocks_give_the_same(make_docs, monkeypatch):
    docs = documents()
    monkeypatch.setattr(S, "BLOCK_WORDS", 40)
    assert sorted(map(tuple, S.report(S.repeated(make_docs(docs).repartition(3))).collect()), key=str) == brute(docs)


def test_factors_name_their_source(make_docs):
    docs = documents()
    texts = {i: (t or "").split() for i, t in docs}
    seen = 0
    for r in S.repeated(make_docs(docs)).collect():
        for f in r.factors or []:
            assert f.length >= 13 and (r.doc_id is None or f.source < r.doc_id)
            assert (r.text or "").split()[f.start : f.start + f.length] == texts[f.source][f.source_start : f.source_start + f.length]
            seen += 1
    assert seen > 10


def test_long_text_and_empty_table(make_docs):
    text = " ".join(words(9, 30_000, 5_000))
    rows = {r.doc_id: r for r in S.report(S.repeated(make_docs([(1, text), (2, text)]))).collect()}
    assert rows[1].n_removed == 0 and rows[2].n_removed == 30_000
    assert S.report(S.repeated(make_docs([]))).count() == 0
