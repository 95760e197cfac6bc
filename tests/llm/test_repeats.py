import hashlib
from collections import Counter

import numpy as np
import pytest

from batchlens.llm import rolling, spans, substring, suffix


def cover_brute(units, size):
    """Which units of each sequence lie in a window of ``size`` that starts twice anywhere."""
    seen = Counter()
    for u in units:
        seen.update(u[i:i + size] for i in range(len(u) - size + 1))
    out = []
    for u in units:
        gone = np.zeros(len(u), dtype=bool)
        for i in range(len(u) - size + 1):
            if seen[u[i:i + size]] > 1:
                gone[i:i + size] = True
        out.append(gone)
    return out


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(params=["whole", "parts"])
def sizes(request, monkeypatch):
    """Once as set, once with parts and groups so small that every path is taken."""
    if request.param == "parts":
        monkeypatch.setattr(substring, "SLICE", 2000)
        monkeypatch.setattr(substring, "PART", 100)
        monkeypatch.setattr(suffix, "SLICE", 2000)
        monkeypatch.setattr(suffix, "COMPARED", 500)


def test_substring(docs, in_order, sizes):
    words = [tuple((t or "").encode().split()) for _, t in in_order]
    want = Counter()
    for (i, _), w, gone in zip(in_order, words, cover_brute(words, substring.WINDOW), strict=True):
        want[i, len(w), int(gone.sum()), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))] += 1
    got = substring.remove_repeats(docs).select("rest.doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == want
    assert sum(r[2] for r in want) > 1000


def test_substring_stage_keeps_columns_and_untouched_texts(docs, empty, in_order):
    made = substring.clean(docs)
    assert made.columns == docs.columns and made.count() == docs.count()
    kept = {r["doc_id"]: r["text"] for r in made.collect()}
    assert kept[58] is None and kept[60] == "   \n\t " and kept[62] == ""
    assert substring.clean(empty).count() == 0


def test_suffix(docs, empty, in_order, sizes):
    data = [(t or "").encode() for _, t in in_order]
    want = Counter()
    for (i, _), d, gone in zip(in_order, data, cover_brute(data, suffix.LENGTH), strict=True):
        left = np.frombuffer(d, dtype=np.uint8)[~gone].tobytes()
        stretches = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want[i, len(d), int(gone.sum()), stretches, sha(left)] += 1
    got = suffix.remove_repeats(docs).drop("kept").collect()
    assert Counter(map(tuple, got)) == want
    assert suffix.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("mode", ["substring", "suffix"])
def test_repeats_without_spark(mode):
    """Random texts over few words, so that windows overlap, repeat inside a text and at its ends."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        vocabulary = [bytes([97 + i]) * int(rng.integers(1, 5)) for i in range(int(rng.integers(1, 5)))]
        source = [vocabulary[i] for i in rng.integers(0, len(vocabulary), 900)]
        texts = []
        for _ in range(6):
            a, b = sorted(rng.integers(0, len(source), 2))
            texts.append(b" ".join([*source[a:b], *(vocabulary[i] for i in rng.integers(0, len(vocabulary), 20))]))
        if mode == "substring":
            units, size = [tuple(t.split()) for t in texts], substring.WINDOW
            text, first, node, _ = substring.windows(texts)
            twice, _ = rolling.repeated(node)
        else:
            units, size = texts, suffix.LENGTH
            ends = np.cumsum([len(t) for t in texts])
            found = suffix.phrases(b"".join(texts), ends - [len(t) for t in texts], ends)
            hashes = suffix._string_hashes(np.frombuffer(b"".join(texts), dtype=np.uint8), (ends - [len(t) for t in texts])[found["text"]] + found["first"], found["size"])
            text, first = np.repeat(found["text"], found["size"]), rolling.spread(found["first"], found["size"])
            twice, _ = rolling.repeated(hashes)
        got = [np.zeros(len(u), dtype=bool) for u in units]
        for t, f in zip(text[twice], first[twice], strict=True):
            got[t][f:f + size] = True
        for g, w in zip(got, cover_brute(units, size), strict=True):
            assert (g == w).all()


def test_spans_cover():
    assert spans.covered(5, None).tolist() == [False] * 5
    assert spans.covered(5, [{"first": 0, "last": 2}, {"first": 1, "last": 3}]).tolist() == [True] * 3 + [False] * 2


def test_substring_spans_are_stored_before_the_texts_are_shuffled(docs):
    """Else the shuffle files of all windows lie on disk beside those of the texts."""
    plan = substring.remove_repeats(docs)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "hashpartitioning(bucket" not in plan
