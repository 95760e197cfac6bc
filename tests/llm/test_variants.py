import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from batchlens.llm import variants
from batchlens.session import LoopState


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    near_to = {w: [o for o in words if abs(len(o) - len(w)) < 2 and o != w and near(o, w)] for w in words}
    form = {}
    for w, others in near_to.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near_to[w]), words[form[w]] if form[w] else None))
    return out


def texts_with_variants():
    """Chains of ever more frequent words, ties, umlauts, a very long word, one-letter rows."""
    chain = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdewyx"]
    rows = [(k * 100 + i, f" {word}." * times) for k, (word, times) in enumerate(zip(chain, [1, 20, 400, 8000], strict=True)) for i in range(4)]
    rows += [(400, "Straßen STRAßEN straÀen straàen straÀens straaens straens aaaaaaa aaaaaaaa aaaaaaaa aaaaaaa aaaaaaaab aaaaaaaab")]
    rows += [(401, f"{'lang' * 5000} {'lang' * 5000} {'lang' * 5000}s {'lang' * 5000}s × a÷bcdefg a÷bcdefg")]
    rows += [(402, None), (403, ""), (404, "short one"), (None, "without identity identity"), (405, "tiewords " * 2 + "tieword " * 20 + "tiewordx " * 20), (405, "tiewords")]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_variants_equal_brute_force(spark, monkeypatch, small):
    if small:  # several rounds of filters, several chunks, words split between slices
        monkeypatch.setattr(variants, "ROUND_BYTES", 64)
        monkeypatch.setattr(variants, "CHUNK", 2)
        monkeypatch.setattr(variants, "LETTER_SLICE", 50)
    rows = texts_with_variants()
    docs = spark.createDataFrame([(i, t, "w") for i, t in rows], "doc_id long, text string, word string").repartition(3)
    got = list(map(tuple, variants.group_variants(docs).collect()))
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert any(r[1] and r[2] != r[1] for r in got)  # a chain of several steps


def test_variants_of_nothing(empty):
    assert variants.group_variants(empty).count() == 0


def test_roots_follow_long_chains(spark):
    links = spark.createDataFrame([(str(i), str(i + 1)) for i in range(37)], "word string, root string")
    got = {r["word"]: r["root"] for r in variants.roots(LoopState(spark, "t"), links).collect()}
    assert got == {str(i): "37" for i in range(37)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aabé", min_size=1, max_size=9), min_size=1, max_size=5))
def test_edit_hashes_are_those_of_the_edited_words(words):
    import pyarrow as pa

    letters = "abcé"
    points, sizes = variants.code_points(pa.array(words))
    got = Counter()
    for word, made, size in variants.edits(points, sizes, np.array([ord(c) for c in letters], dtype=np.uint64)):
        got.update(zip(word.tolist(), made.tolist(), size.tolist(), strict=True))
    want = Counter()
    for i, w in enumerate(words):
        others = {w[:k] + w[k + 1:] for k in range(len(w))} | {w[:k] + c + w[k + 1:] for k in range(len(w)) for c in letters if c > w[k]}
        for o in others:
            p, s = variants.code_points(pa.array([o]))
            want[i, int(variants.word_hashes(p, s)[0]) if o else int(variants.finish(np.zeros(1, dtype=np.uint64), s)[0]), len(o)] += 1
    assert got == want


def test_filters_have_every_word_and_few_others():
    rng = np.random.default_rng(2)
    hashes, sizes = rng.integers(0, 1 << 64, 20_000, dtype=np.uint64), rng.integers(7, 90, 20_000)
    layout = variants.Layout.of(Counter(sizes.tolist()))
    block, bits = layout.block_of(hashes, sizes), np.zeros(layout.total * variants.BLOCK_WORDS, dtype=np.uint64)
    codes = variants.probe_codes(hashes)
    for i in range(variants.PROBES):
        nine = codes >> np.uint64(9 * i)
        np.bitwise_or.at(bits, block * variants.BLOCK_WORDS + (nine & np.uint64(7)).astype(int), np.uint64(1) << (nine >> np.uint64(3) & np.uint64(63)))
    filters = variants.Filters(layout, 0, bits)
    assert len(filters.positive(hashes, sizes)) == len(hashes)
    others = rng.integers(0, 1 << 64, 200_000, dtype=np.uint64)
    assert len(filters.positive(others, rng.integers(7, 90, 200_000))) < 600
