import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from batchlens.llm import align
from batchlens.llm.words import LETTERS

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BYTE = {letter: i for i, letter in enumerate(LETTERS)}


def brute(rows):
    """The contract, document by document and token by token."""
    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    read, counts = [], Counter()
    for i, text in rows:
        a, b = [], []
        if text:
            a = [(t, bytes(BYTE[c] for c in a_lib.id_to_token(t))) for t in a_lib.encode(" " + text, add_special_tokens=False).ids]
            pieces = [(t, b_lib.id_to_piece(t)) for t in b_lib.encode(text)]
            b = [(t, bytes([int(p[3:5], 16)]) if b_lib.is_byte(t) else p.replace("▁", " ").encode()) for t, p in pieces]
            if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                a, b = [], []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for t, x in side:
                out.append((t, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links, j = [], 0
        for t, begin, end in spans[0]:
            while j < len(spans[1]) and spans[1][j][2] <= begin:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < end:
                links.append((t, spans[1][k][0]))
                k += 1
        common = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, at = [], [0, 0]
        for end in common:
            shown = []
            for s in range(2):
                first = at[s]
                while at[s] < len(spans[s]) and spans[s][at[s]][2] <= end:
                    at[s] += 1
                shown.append(",".join(str(t) for t, *_ in spans[s][first:at[s]]))
            groups.append("|".join(shown))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        read.append((i, len(a), len(b), len(common), links, digest))
        counts.update(links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return Counter((i, n_a, n_b, n_groups, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), digest)
                   for i, n_a, n_b, n_groups, links, digest in read)


def test_alignment_equals_brute_force(spark, docs, empty, in_order, monkeypatch):
    extra = [(71, "a▁b"), (72, " ▁"), (73, "</s> <s> <|endoftext|> <0x0A>")]
    more = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    want = brute([*in_order, *extra])
    assert Counter(map(tuple, align.align(more, A, B).collect())) == want
    monkeypatch.setattr(align, "SLICE", 2000)
    monkeypatch.setattr(align, "BLOCK_PAIRS", 300)
    assert Counter(map(tuple, align.align(more, A, B).collect())) == want
    assert align.align(empty, A, B).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aB .'\n0é日!😀 \xa0▁")), max_size=30), min_size=1, max_size=4))
def test_tokens_cover_each_other(texts):
    made = align.pair_of(A, B)
    found = made.align([t.encode() for t in texts])
    for t, a, b in zip(texts, found.counts_a.tolist(), found.counts_b.tolist(), strict=True):
        assert (a > 0) == (b > 0) == bool(t and "▁" not in t)
    # every token is linked, and overlaps are as many as there are token starts on either side
    assert len(np.unique(found.link_a)) == len(found.ids_a) and len(np.unique(found.link_b)) == len(found.ids_b)
    assert (found.n_links == found.counts_a + found.counts_b - found.n_groups).all()


def test_planes_round_trip():
    values = np.array([0, 1, 255, 256, 70_000, 2**32 - 1])
    assert align.from_planes(align.planes(values)).tolist() == values.tolist() and align.from_planes(b"").tolist() == []
