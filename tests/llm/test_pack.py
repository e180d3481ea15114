import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import pack as P

from .conftest import EDGES, words

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a  b", "  x", "x \n y", "tab\there", "a\n\nb", "<|endoftext|> x", "it's don't 12abc é", "x ", "\n", "a b", "a\x1cb c d", "one\ntwo three\n"]


@pytest.fixture(scope="module")
def ids():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_cached_tokenizer_is_the_tokenizer(ids):
    cached = P.CachedTokenizer(PATH, most=50)
    for text in [*ODD, *(t for _, t in EDGES if t), *ODD]:
        assert [*np.frombuffer(cached(text), "<u4").tolist(), 0] == ids(text), repr(text)


@pytest.mark.parametrize("lot", [3, 2_048])
def test_each_id_lies_in_one_piece(spark, make_docs, ids, lot):
    docs = EDGES + [(100 + k, t) for k, t in enumerate(ODD)] + [(200 + k, " ".join(words(k, 7 * k))) for k in range(60)]
    frame = make_docs(docs).repartition(3)
    rows = P.with_steps(P.pack(frame, PATH, lot=lot, keep_ids=True), step_tokens=2_048).collect()
    # documents, by their pieces
    pieces = defaultdict(list)
    for r in rows:
        assert r.length > 0 and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces[r.doc_id].append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist(), r.doc_tokens))
    for doc, text in docs:
        if doc != 6:  # two equal rows
            joined, at = [], 0
            for start, own, total in sorted(pieces[doc]):
                assert start == at and total == len(ids(text))
                joined += own
                at += len(own)
            assert joined == ids(text)
    assert sum(len(p[1]) for p in pieces[6]) == 2 * len(ids("same text here"))
    # sequences
    places, short = defaultdict(list), 0
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length, r.tier, r.task))
    for own in places.values():
        at = 0
        for offset, length, _, _ in sorted(own):
            assert offset == at
            at += length
        assert at <= own[0][2] <= 1024
        short += at & (at - 1) != 0
    assert short <= len({r.task for r in rows})
    # steps: full but for the last of each tier
    tokens = defaultdict(int)
    for r in rows:
        tokens[r.tier, r.step] += r.length
    last = {t: max(s for u, s in tokens if u == t) for t, _ in tokens}
    assert all(n == 2_048 for (t, s), n in tokens.items() if s < last[t])


def test_empty_table(make_docs):
    assert P.with_steps(P.pack(make_docs([]), PATH)).count() == 0


def test_forgotten_words_are_learnt_again():
    small, large = (P.CachedTokenizer(PATH, most) for most in (5, 1_000))
    texts = [f"some word{k} and word{k + 1} too\nnext line{k} with  blanks" for k in range(40)] * 2 + [f"plain word{k} again" for k in range(40)]
    assert [small(t) for t in texts] == [large(t) for t in texts] == [large._whole(t) for t in texts]
