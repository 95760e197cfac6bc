import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from batchlens.llm import bpe, packing, rans, token_files, words

ODD = st.text(alphabet=st.sampled_from("aB .,'\n\t0é İ日!😀s 　\xa0\x85 Kà\x1c|<>"), max_size=60)
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def split(ids, ends):
    return [ids[a:b].tolist() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_librarys_ids(name, texts):
    coder, ids = words.TextCoder(public_tokenizers.path(name)), library(name)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(ODD, min_size=1, max_size=4))
    def check(some):
        assert split(*coder.encode([t.encode() for t in some])) == [ids(t) for t in some]

    check()
    whole = [t or "" for t in texts.values()]
    assert split(*coder.encode([t.encode() for t in whole])) == [ids(t) for t in whole]


def test_piece_table_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(words, "KEPT", 5)
    coder, ids = words.TextCoder(public_tokenizers.path("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    for text in ("a b c d e f g h", "h g f", "", "x y z a b"):
        assert split(*coder.encode([text.encode(), b""])) == [ids(text), []]


def test_rank_queue_equals_tiktoken():
    coder = bpe.TextCoder(RANKS, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks.of, special_tokens={})

    @settings(max_examples=150, deadline=None)
    @given(st.lists(ODD, min_size=1, max_size=4))
    def check(some):
        for text, ids in zip(some, coder.encode([t.encode() for t in some]), strict=True):
            assert ids.tolist() == other.encode_ordinary(text)
            assert coder.ranks.decode(ids) == text.encode()

    check()
    for long in ("a" * 3000, "ab" * 50_000, "the" * 999, "日本" * 500):
        assert coder.ranks.merge_one(long.encode()) == other.encode_ordinary(long)
        assert next(coder.encode([long.encode()])).tolist() == other.encode_ordinary(long)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, (1 << 18) - 1), max_size=50))
def test_bitmap_finds_the_lowest_rank(ranks):
    queue = bpe.RankQueue()
    for r in ranks:
        queue.bucket(r).append(r)
    taken = []
    while (low := queue.first()) >= 0:
        taken += queue.remove(low)
    assert taken == sorted(ranks)


def test_bpe_digests(docs, empty, in_order):
    ranks = bpe.Ranks(RANKS).of
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter(map(tuple, bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, t in in_order:
        ids = other.encode_ordinary(t or "")
        want[i, len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha((t or "").encode())] += 1
    assert got == want
    assert bpe.digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 299), max_size=3000), st.integers(1, 40))
def test_rans_round_trip(ids, docs):
    ids = np.array(ids, dtype=np.uint32)
    shared = rans.table(np.bincount(ids, minlength=50_000))
    shared.symbol = rans.slots_of(shared)
    cuts = np.sort(np.random.default_rng(docs).integers(0, len(ids) + 1, docs - 1))
    sizes = np.diff([0, *cuts, len(ids)])
    owners = [None if i == 1 else i * 7 for i in range(docs)]
    block = rans.Block(rans.encode_block(owners, sizes, ids, shared), shared)
    assert block.owners == owners and block.sizes.tolist() == sizes.tolist() and block.ids().tolist() == ids.tolist()


def test_rans_segments_decode_alone_and_damage_is_seen(monkeypatch):
    ids = np.random.default_rng(0).zipf(1.3, 3 * rans.SEGMENT // 2).clip(0, 49_999).astype(np.uint32)
    shared = rans.table(np.bincount(ids, minlength=50_000))
    shared.symbol = rans.slots_of(shared)
    data = rans.encode_block([1], np.array([len(ids)]), ids, shared)
    assert len(data) < 2 * len(ids)
    assert rans.Block(data, shared).segment(1).tolist() == ids[rans.SEGMENT:].tolist()
    with pytest.raises(ValueError):
        rans.Block(data[:-100] + b"\0" + data[-99:], shared)


def test_frequencies_fill_the_table():
    counts = np.ones(50_000, dtype=np.int64)
    counts[3] = 10**15
    for c in (counts, counts * 0, np.bincount([4], minlength=10), np.arange(60_000)):
        f = rans.table(c).frequency
        assert f.sum() in (0, 1 << rans.PRECISION) and ((f > 0) == (c > 0)).all()


def test_token_files(docs, empty, in_order, monkeypatch):
    ids = library("byte_bpe_50k.json")
    files = token_files.write(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read(files).collect()), key=lambda r: (r[0], r[1]))
    at, want = 0, []
    for i, t in sorted(in_order, key=lambda r: -1 if r[0] is None else r[0]):
        whole = [*ids(t), 0]
        want.append((-1 if i is None else i, at, len(whole), crc(whole)))
        at += len(whole)
    assert got == want
    assert token_files.read(token_files.write(empty, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)).count() == 0


def test_packing(docs, empty, in_order):
    ids = library("word_bpe_49k.json")
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(docs, path, end_id=2).collect()
    want = Counter()
    for i, t in in_order:
        whole = [*ids(t), 2]
        for at in range(0, len(whole), 4096):
            want[i, at, len(whole[at:at + 4096]), crc(whole[at:at + 4096]), len(whole)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for spots in sequences.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end
            end += length
        assert end <= 4096
    assert packing.pack_documents(empty, path, end_id=2).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 256), st.integers(1, 400)), max_size=40))
def test_packing_plan_places_every_piece(bins):
    counts = np.zeros(257, dtype=np.int64)
    for length, n in bins:
        counts[length] += n
    made = packing.plan(counts, unit=2, most=20)
    load = Counter()
    seen = np.zeros(len(made.origin), dtype=np.int64)
    for length, n in enumerate(counts.tolist()):
        k = made.kind[length] if len(made.kind) else 0
        for _ in range(n):
            slot = made.origin[k] + seen[k]
            run = np.searchsorted(made.first, slot, side="right") - 1
            load[int(made.base[run] + (slot - made.first[run]) // made.per[run])] += length
            seen[k] += 1
    assert all(v <= 256 for v in load.values()) and set(load) == set(range(made.sequences))


def test_column_generation_fills_sequences():
    rng = np.random.default_rng(1)
    lengths = np.clip(rng.lognormal(6.3, 0.9, 50_000).astype(int), 1, 4096)
    made = packing.plan(np.bincount(lengths, minlength=4097))
    assert lengths.sum() / 4096 / made.sequences > 0.98
