import zlib

import corpus_pipeline
from plumbline.llm import jaccard, quality, secret_scan
from plumbline.llm.common import written

from .conftest import EDGES
from .test_decontaminate import cut
from .test_jaccard import brute

SF = "/root/testdata/sf0.001"
NAMES = list(corpus_pipeline.COLUMNS)


def test_each_stage_on_the_output_before(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[a : a + min(10, len(w))]) for w in map(cut, items) for a in range(max(1, len(w) - 9)) if w}
    before = docs.select(*NAMES).collect()
    for name, stage in corpus_pipeline.STAGES:
        out, _ = written(stage(spark, docs, SF), f"test-{name}")
        rows = out.collect()
        if name != "packing":
            assert out.columns == NAMES
        if name == "quality_classifier":
            keep = {r.doc_id for r in quality.report(docs).collect() if r.keep}
            assert sorted(rows) == sorted(r for r in before if r.doc_id in keep) and len(rows) < len(before)
        elif name == "jaccard_join":
            lead = {i for i, c, _ in brute([(r.doc_id, r.text) for r in before]) if i == c}
            assert sorted(rows) == sorted(r for r in before if r.doc_id in lead) and len(rows) < len(before)
        elif name == "decontamination":
            def hit(text):
                w = cut(text)
                return any(tuple(w[a : a + n]) in grams for n in {len(g) for g in grams} for a in range(len(w) - n + 1))

            assert sorted(rows) == sorted(r for r in before if not hit(r.text)) and len(rows) < len(before)
        elif name == "secret_scan":
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in before)
            assert not any(secret_scan.base_spans(r.text) for r in rows)
            old = {r.doc_id: r for r in before}
            assert all(r == old[r.doc_id] for r in rows if "[SECRET]" not in r.text)
        else:
            assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())
            assert {r.doc_id for r in rows} == {r.doc_id for r in before}
            assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
        docs, before = out, rows


def test_edges_and_extra_columns(spark, make_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, make_docs([]), SF).count() == 0
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, make_docs(EDGES), SF).count() > 0
    assert jaccard.one_of_each(make_docs(EDGES)).count() == len(EDGES) - 1
