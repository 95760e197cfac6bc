from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from batchlens.llm import langid, simhash
from batchlens.llm.components import components
from batchlens.session import LoopState


def fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(nodes, linked):
    """Smallest reachable node of each node."""
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if label[b] < label[a] and linked(a, b):
                    label[a], changed = label[b], True
    return label


@pytest.mark.parametrize("edges", [[], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 300)], [(1, 1), (5, 3), (3, 5), (9, 7), (7, 3), (20, 21)]])
def test_components(spark, edges):
    rows = spark.createDataFrame(edges, "a long, b long")
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    assert {r["node"]: r["component"] for r in components(rows).collect()} == groups(sorted(near), lambda a, b: b in near[a])


def test_fingerprints(docs, in_order):
    got = Counter((r["doc_id"], r["fp"] % (1 << 64)) for r in simhash.fingerprints(docs).collect())
    assert got == Counter((i, fingerprint(t)) for i, t in in_order)


def test_near_duplicates(docs, empty, in_order):
    fps = {fingerprint(t) for _, t in in_order}
    label = groups(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, t in in_order:
        if i is not None:
            key = label[fingerprint(t)]
            least[key] = min(least.get(key, i), i)
    want = Counter((i, least.get(label[fingerprint(t)])) for i, t in in_order)
    assert Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({i if i is not None else None: 1 for i in {*least.values()}} | {None: 1})


@pytest.mark.parametrize("paired", [0, 3, 32])
def test_links_of_dense_and_sparse_fingerprints(spark, monkeypatch, paired):
    """Any size of meeting, down to none paired, gives the components of all links."""
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = {int(s) for s in seeds} | {0, (1 << 64) - 1, 1, 3, 7, 15}
    for s in seeds[:10]:
        for _ in range(25):
            flips = rng.integers(0, 64, rng.integers(1, 4))
            fps.add(int(s) ^ int(np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64))))
    signed = {f - (1 << 64) if f >= 1 << 63 else f for f in fps}
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), LoopState(spark, "test"))
    assert links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).count() == 0
    label = groups(sorted(signed), lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2)
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert {f: got.get(f, f) for f in signed} == label


@pytest.fixture(scope="module")
def network(spark):
    return langid.train(langid.sample(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))


def test_held_out_accuracy(spark, network):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.predict(docs, network).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() > 0.97 * found.count()


def test_tables_equal_the_network(network):
    rng = np.random.default_rng(0)
    x = langid.FOLD[rng.integers(0, 256, (9, langid.WINDOW))]
    e, pooled = network.embed[x], []
    for w, f in zip(langid.WIDTHS, network.filters, strict=True):
        view = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, w * langid.EMBED)
        pooled.append((view @ f).max(axis=1))
    want = langid.softmax(np.maximum(np.concatenate(pooled, axis=1) + network.bias, 0) @ network.out + network.out_bias)
    assert np.abs(langid.Predictor(network).probabilities(x) - want).max() < 1e-5


def test_gradients_are_those_of_the_loss(network):
    rng = np.random.default_rng(1)
    x, y = langid.FOLD[rng.integers(97, 123, (4, langid.WINDOW))], np.array([0, 1, 2, 3])
    params = [network.embed, *network.filters, network.bias, network.out, network.out_bias]

    def loss():
        e, pooled = network.embed[x].astype(float), []
        for w, f in zip(langid.WIDTHS, network.filters, strict=True):
            view = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, w * langid.EMBED)
            pooled.append((view @ f).max(axis=1))
        p = langid.softmax(np.maximum(np.concatenate(pooled, axis=1) + network.bias, 0) @ network.out + network.out_bias)
        return -np.log(p[np.arange(4), y]).mean()

    for param, g in zip(params, langid.gradients(network, x, y), strict=True):
        spot = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = param[spot]
        param[spot] = old + 1e-3
        up = loss()
        param[spot] = old - 1e-3
        down = loss()
        param[spot] = old
        assert (up - down) / 2e-3 == pytest.approx(g[spot], rel=0.1, abs=1e-4)


def test_language_cases(docs, empty, in_order, network):
    rows = {r["doc_id"]: r for r in langid.predict(docs, network).collect()}
    for i in (58, 59, 60, 61):
        assert rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0
    assert rows[None]["held_out"] is False
    assert rows[65]["lang_pred"] in network.labels and 0 <= rows[65]["score"] <= 1
    assert langid.predict(docs, network).count() == len(in_order)
    assert langid.identify(empty).count() == 0 and langid.keep_identified(empty).count() == 0
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {i for i, t in in_order if i is not None and i not in (58, 59, 60, 61)} - {65, 66}
    assert not {58, 59, 60, 61} & {r["doc_id"] for r in kept.collect()}


def test_labels_of_the_other_fold_are_not_used(spark):
    """Changing every held-out label changes nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumn("lang", F.when(langid.in_training(F.col("doc_id")), F.col("lang")).otherwise("zz"))
    assert langid.sample(docs) == langid.sample(other)
