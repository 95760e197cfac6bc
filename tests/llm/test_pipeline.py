import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
from batchlens.llm import queries, similar


def test_stages_pass_documents_on(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "substring_dedup", "packing"]
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, "/root/testdata/sf0.001").collect(), docs.schema)
        assert now.columns == docs.columns
        seen.append({r["doc_id"] for r in now.collect()})
    assert 58 not in seen[0] and 5 in seen[1] and not {52, 53, 57} & seen[1]
    assert seen[2] == seen[1]


def test_planted_near_copies_go(spark, empty):
    """Copies with five-word similarity 0.8 to 0.95 go, all of them; those below stay."""
    rng = random.Random(3)
    sets = lambda t: {tuple(t[i:i + 5]) for i in range(len(t) - 4)}
    rows, near, far = [], set(), set()
    for base in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((1000 * base, " ".join(words)))
        for copy, changes in enumerate((1, 2, 3, 4, 6, 8, 12), 1):
            new = list(words)
            for at in rng.sample(range(200), changes):
                new[at] = f"x{rng.randrange(10**9)}"
            a, b = sets(words), sets(new)
            likeness = len(a & b) / len(a | b)
            if 0.8 <= likeness <= 0.95:
                near.add(1000 * base + copy)
            elif likeness < 0.75:
                far.add(1000 * base + copy)
            rows.append((1000 * base + copy, " ".join(new)))
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    left = {r["doc_id"] for r in stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert len(near) > 150 and not near & left and far <= left
    assert stage(spark, empty, "").count() == 0


def test_groups_are_those_of_all_pairs(spark, monkeypatch):
    """Components of links at 0.8 by brute force, with passages that many texts share and chains of near copies."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(400)}"
    passages = [[word() for _ in range(60)] for _ in range(3)]
    texts = [[word() for _ in range(rng.randrange(0, 40))] + rng.choice(passages) + [word() for _ in range(rng.randrange(0, 60))] for _ in range(80)]
    for base in range(0, 40, 5):
        now = list(texts[base])
        for _ in range(4):
            now = list(now)
            now[rng.randrange(len(now))] = word()
            texts.append(now)
    texts += [["a", "b"], ["A", "b"], [], [], ["a"], ["x"] * 50, ["x"] * 30]
    rows = [(i, "  \n".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, "a\tb")]

    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: grams(t) for i, t in rows}
    near = lambda a, b: a == b or (a and b and 10 * len(a & b) >= 8 * len(a | b))
    root = {i: i for i in sets}
    for _ in range(len(sets)):
        new = {i: min(root[j] for j in sets if near(sets[i], sets[j])) for i in sets}
        if new == root:
            break
        root = new
    want = {}
    for i, r in root.items():
        want.setdefault(r, set()).add(i)
    for bits, few in ((1 << 28, similar.FEW), (1 << 10, 0)):  # as it is; a full filter and all rounds
        monkeypatch.setattr(similar, "FEW", few)
        monkeypatch.setattr(similar, "FILTER_BITS", bits)
        monkeypatch.setattr(similar, "CHUNK_BITS", min(bits, 1 << 12))
        got = {}
        for r in similar.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
            got.setdefault(r["component"], set()).add(r["doc_id"])
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_run_packs_what_is_left(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    want = set()
    for r in docs.collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want |= {(r["doc_id"], at, zlib.crc32(ids[at:at + 4096].tobytes())) for at in range(0, len(ids), 4096)}
    assert {(r["doc_id"], r["start"], r["ids_crc32"]) for r in rows} == want


def test_every_operator_is_registered():
    found = [q for q in __spark_entry__.queries() if q.startswith("op") and q[2].isdigit()]
    assert sorted(int(q[2:].split("_")[0]) for q in found) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries() and set(queries.ORACLES) <= set(queries.QUERIES)
