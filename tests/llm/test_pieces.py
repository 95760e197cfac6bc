import hashlib
import itertools
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from batchlens.llm import sentence_pieces
from batchlens.llm.charmap import CharMap

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = st.text(alphabet=st.sampled_from(list("aB .,'\n\t0é İ日!😀s 　\xa0\x85 Kà\x1c|<>▁ﬁ①́が゙Å​­\x00ﷺ㌀½")), max_size=40)
#: Several characters to one, one to several, to none, and overlapping sources.
OWN_MAP = [*{"ab": "x", "abc": "yz", "b": "", "é": "e'", "a b": " ", "日": "sun day", "!": "!!"}.items()]


def char_ends(text):
    """Byte place of every character border to its number."""
    return {p: i for i, p in enumerate(itertools.accumulate((len(c.encode()) for c in text), initial=0))}


def joined(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), dtype=np.uint8), [len(d) for d in data]


@pytest.mark.parametrize("rule", [{"rule_name": "nmt_nfkc"}, {"norm_map": OWN_MAP}], ids=["nfkc", "own"])
@pytest.mark.parametrize("prefix", [False, True])
@pytest.mark.parametrize("squeeze", [False, True])
def test_normalisation_and_sources_are_the_librarys(rule, prefix, squeeze):
    library = sentencepiece.SentencePieceNormalizer(**rule, add_dummy_prefix=prefix, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(library.serialized_model_proto())
    made = CharMap(spec.normalizer_spec.precompiled_charsmap, prefix, squeeze)
    parts = st.text(alphabet=st.sampled_from(list("aabbc é日! ▁")), max_size=30) if "norm_map" in rule else ODD

    @settings(max_examples=150, deadline=None)
    @given(st.lists(parts, min_size=1, max_size=4))
    def check(texts):
        found = made.normalise(*joined(texts))
        start = base = 0
        for text, end, stop in zip(texts, found.ends.tolist(), found.stop.tolist(), strict=True):
            got = found.raw[start:end].tobytes()
            want, places = library.normalize(text, with_offsets=True)
            assert got.decode() == want.replace("▁", " ")
            if got:
                border = char_ends(text)
                mine = [o - base for o, b in zip(found.origin[start:end].tolist(), got, strict=True) if b & 0xC0 != 0x80] + [stop - base]
                assert [border[o] for o in mine] == list(places)
            start, base = end, base + len(text.encode())

    check()


@pytest.fixture(scope="session")
def folded_path(tmp_path_factory):
    """The vocabulary with a character map that composes, folds and drops characters."""
    spec = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as file:
        spec.ParseFromString(file.read())
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    other = sentencepiece_model_pb2.ModelProto()
    other.ParseFromString(library.serialized_model_proto())
    spec.normalizer_spec.CopyFrom(other.normalizer_spec)
    path = tmp_path_factory.mktemp("pieces") / "folded.model"
    path.write_bytes(spec.SerializeToString())
    return str(path)


@pytest.mark.parametrize("folded", [False, True])
def test_ids_and_spans_are_the_librarys(folded, folded_path, texts):
    made = sentence_pieces.Model(folded_path if folded else PATH)

    def check(some):
        for text, (ids, begins, ends) in zip(some, made.framed([t.encode() for t in some]), strict=True):
            want = made.library.encode(text, return_type="proto")
            assert ids.tolist() == [made.bos, *(p.id for p in want.pieces), made.eos]
            assert begins[1:-1].tolist() == [p.begin for p in want.pieces]
            assert ends[1:-1].tolist() == [p.end for p in want.pieces]
            assert begins[0] == ends[0] == 0 and begins[-1] == ends[-1] == len(text.encode())

    settings(max_examples=150, deadline=None)(given(st.lists(ODD, min_size=1, max_size=4))(check))()
    check([t or "" for t in texts.values()])


def test_long_parts_are_encoded_whole():
    made = sentence_pieces.Model(PATH)
    for text in ("ab" * 100_000, " " * 5000 + "x", "日本" * 20_000):
        (ids, _, ends), = made.framed([text.encode()])
        assert ids.tolist() == made.library.encode(text, add_bos=True, add_eos=True) and ends[-2] == len(text.encode())


def test_other_models_are_refused(tmp_path):
    spec = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as file:
        spec.ParseFromString(file.read())
    spec.trainer_spec.byte_fallback = False
    (tmp_path / "m.model").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError):
        sentence_pieces.Model(str(tmp_path / "m.model"))


def test_sentence_piece_digests(docs, empty, in_order):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = Counter(tuple(r)[:4] for r in sentence_pieces.digests(docs, PATH).collect())
    want = Counter()
    for i, t in in_order:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want[i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert got == want
    assert all(r["covered_bytes"] <= len((dict(in_order)[r["doc_id"]] or "").encode()) for r in sentence_pieces.digests(docs, PATH).collect())
    assert sentence_pieces.digests(empty, PATH).count() == 0


def test_written_ids_and_spans(docs, in_order):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = dict(in_order)
    for r in sentence_pieces.encode(docs, PATH).collect():
        text = (texts[r["doc_id"]] or "").encode()
        ids, begins, ends = (np.frombuffer(r[c], dtype="<u4") for c in ("ids", "begins", "ends"))
        assert ids.tolist() == library.encode(text.decode(), add_bos=True, add_eos=True)
        covered = ends > begins
        assert b"".join(text[b:e] for b, e in zip(begins[covered], ends[covered], strict=True)) == text
