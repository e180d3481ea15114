import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import align
from tests.llm.conftest import EDGES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIRST, SECOND = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
FIRST.encode_special_tokens = True
KNOWN = align.Aligner(A, B)


def brute_tokens(text):
    """Groups of a text, from whole tokenisations and the entries of the vocabularies."""
    if not text:
        return []
    alphabet = align.byte_alphabet()
    a = FIRST.encode(" " + text, add_special_tokens=False).ids
    b = SECOND.encode(text)
    bytes_a = [bytes(alphabet[c] for c in FIRST.id_to_token(i)) for i in a]
    pieces = [SECOND.id_to_piece(i) for i in b]
    bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return []
    groups, at_a, at_b, i, k = [], 0, 0, 0, 0
    own_a, own_b = [], []
    while i < len(a) or k < len(b):
        if at_a <= at_b:
            own_a.append(a[i])
            at_a += len(bytes_a[i])
            i += 1
        else:
            own_b.append(b[k])
            at_b += len(bytes_b[k])
            k += 1
        if at_a == at_b:
            groups.append((own_a, own_b))
            own_a, own_b = [], []
    return groups


def brute(rows):
    groups = [brute_tokens(t) for _, t in rows]
    counts = Counter((a[-1], b[-1]) for own in groups for a, b in own)
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for (doc_id, _), own in zip(rows, groups, strict=True):
        links = [(a[-1], b[-1]) for a, b in own]
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in own)
        out.append((
            doc_id, sum(len(a) for a, _ in own), sum(len(b) for _, b in own), len(own), len(links), sum(counts[x] == top[x[1]] for x in links),
            sum(counts[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if own else "",
        ))
    return sorted(out, key=str)


def got(result):
    return sorted(map(tuple, result.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("ab é\n\t1.'s 　<>|中▁\x00\r\x1c\x85 ")), max_size=14))
def test_segments_give_what_whole_texts_give(text):
    expected = (KNOWN.whole(" " + text) if text else None) or KNOWN.NOTHING
    assert KNOWN.many([text])[0] == expected
    assert expected[2] == len(brute_tokens(text))


def test_edges_and_lossy_texts(spark, make_docs):
    rows = [*EDGES, (8, "a▁b c"), (9, "<|endoftext|> and </s>"), (10, "  two  blanks "), (11, "\n\n"), (12, "one two\nthree"), (12, "one two\nthree")]
    assert got(align.align(make_docs(rows), A, B)) == brute(rows)
    assert got(align.align(make_docs([(1, "▁"), (2, None)]), A, B)) == brute([(1, "▁"), (2, None)])
    assert got(align.align(make_docs([]), A, B)) == []


def test_whole_table_with_small_chunks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    copies = [(100_000 + k, rows[3][1]) for k in range(300)]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(copies, "doc_id long, text string"))
    assert got(align.align(more, A, B, chunk_links=5_000)) == brute(rows + copies)


def test_words_are_forgotten_and_learnt_again():
    small = align.Aligner(A, B, remembered=5)
    texts = [f"word{k} and word{k + 1} then" for k in range(50)] * 2
    assert small.many(texts[:1]) + [x for t in texts[1:] for x in small.many([t])] == [KNOWN.whole(" " + t) for t in texts]
