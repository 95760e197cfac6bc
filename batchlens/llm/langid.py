"""Language identification by a byte convolutional network, trained in numpy.

A text is read as UTF-8 bytes (ASCII letters folded to lower case, digits to
one sign) in fixed windows of ``WINDOW`` bytes that cover all of it.  Filters
of several widths run over the windows, their maxima over positions feed a
softmax.  A text's class probabilities are the mean of its windows', weighted
by their bytes.

Training uses at most ``SAMPLE`` labelled documents of the training fold, the
first in the order of a hash, and at most ``PER_DOC`` windows spread over each.
For prediction a filter of width w is a sum of table entries for byte pairs,
so a window costs a few gathers per byte.

Defined results: a text that is null or has no letter (Unicode class L) gives
``und`` with score 0; repeated rows give repeated results; null ids are kept
(held_out false); an empty training fold gives ``und`` for every text; an empty
table gives an empty result; columns other than id, text and language are
ignored, and the language is read in training only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from batchlens.llm.common import bytes_of, id_type, let_go, slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 8
SAMPLE = 4000
PER_DOC = 3
EPOCHS = 8
BATCH = 64
RATE = 3e-3
UNKNOWN = "und"
#: A filter keeps texts whose best language has this score; below it no language stands out.
LEAST_SCORE = 0.3
#: Windows pooled at once, so that their tables stay in the processor's cache.
POOLED = 64

FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A"):ord("Z") + 1] += 32
FOLD[ord("0"):ord("9") + 1] = ord("0")


@dataclass
class Network:
    labels: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]  # one (width * EMBED, FILTERS) matrix per width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def in_training(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) != 0


def cut_windows(data: bytes) -> np.ndarray:
    """Folded windows over all bytes, the last one filled up with zeros."""
    n = -(-len(data) // WINDOW)
    flat = np.zeros(n * WINDOW, dtype=np.uint8)
    flat[: len(data)] = FOLD[np.frombuffer(data, dtype=np.uint8)]
    return flat.reshape(n, WINDOW)


def sample(docs: DataFrame, limit: int = SAMPLE) -> list[tuple[bytes, str]]:
    """A bounded set of labelled training texts, cut to windows spread over each text.

    A hash threshold leaves about twice the wanted rows of the whole table, so
    what meets on the driver does not depend on the number of partitions.
    """
    labelled = docs.where(in_training(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = labelled.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    usable = labelled.where((place <= int((1 << 40) * min(1.0, 2 * limit / max(1, n)))) & F.col("text").rlike(r"\p{L}"))
    room = F.greatest(F.length("text") - WINDOW, F.lit(0))
    spots = [F.substring("text", (room * i / max(1, PER_DOC - 1)).cast("int") + 1, F.lit(WINDOW)) for i in range(PER_DOC)]
    cut = usable.select("lang", F.array_distinct(F.array(*spots)).alias("parts"), place.alias("place"), "doc_id")
    rows = cut.orderBy("place", "doc_id", "lang", "parts").limit(limit).collect()
    return [(p.encode()[:WINDOW], r["lang"]) for r in rows for p in r["parts"]]


def train(examples: list[tuple[bytes, str]], seed: int = 7) -> Network | None:
    """Fit by Adam on cross entropy; the same examples give the same network."""
    if not examples:
        return None
    labels = sorted({lang for _, lang in examples})
    rng = np.random.default_rng(seed)
    x = np.concatenate([cut_windows(t) for t, _ in examples])
    y = np.array([labels.index(lang) for _, lang in examples])
    net = Network(
        labels, rng.normal(0, 0.3, (256, EMBED)).astype(np.float32),
        [rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), dtype=np.float32),
        rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32), np.zeros(len(labels), dtype=np.float32),
    )
    params = [net.embed, *net.filters, net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            step += 1
            for i, g in enumerate(gradients(net, x[rows], y[rows])):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                params[i] -= RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return net


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross entropy: embedding, filters by width, bias, output weights and bias."""
    n = len(x)
    e = net.embed[x]
    pooled, spots, views = [], [], []
    for w, f in zip(WIDTHS, net.filters, strict=True):
        view = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - w + 1, w * EMBED)
        score = view @ f
        spot = score.argmax(axis=1)
        pooled.append(np.take_along_axis(score, spot[:, None], axis=1)[:, 0])
        spots.append(spot)
        views.append(view)
    hidden = np.concatenate(pooled, axis=1) + net.bias
    active = np.maximum(hidden, 0)
    wrong = softmax(active @ net.out + net.out_bias)
    wrong[np.arange(n), y] -= 1
    wrong /= n
    back = (wrong @ net.out.T) * (hidden > 0)
    embed, filters = np.zeros_like(net.embed), []
    for i, (w, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
        part = back[:, i * FILTERS:(i + 1) * FILTERS]
        chosen = views[i][np.arange(n)[:, None], spots[i]]  # n, FILTERS, w * EMBED
        filters.append(np.einsum("nf,nfk->kf", part, chosen).astype(np.float32))
        into = (part[:, :, None] * f.T[None]).reshape(n, FILTERS, w, EMBED)
        symbols = x[np.arange(n)[:, None, None], spots[i][:, :, None] + np.arange(w)]
        np.add.at(embed, symbols, into)
    return [embed, *filters, back.sum(axis=0), active.T @ wrong, wrong.sum(axis=0)]


class Predictor:
    """The network as tables over byte pairs of a reduced alphabet."""

    def __init__(self, net: Network):
        self.net = net
        used, self.code = np.unique(FOLD, return_inverse=True)
        self.size = len(used)
        e = net.embed[used]
        taps = [[e @ f[k * EMBED:(k + 1) * EMBED] for k in range(w)] for w, f in zip(WIDTHS, net.filters, strict=True)]
        pair = [a[:, None, :] + b[None, :, :] for a, b in (t[:2] for t in taps)]
        tail = [t[2][:, None, :] + (t[3][None, :, :] if len(t) > 3 else 0) + np.zeros((self.size, self.size, 1)) for t in taps if len(t) > 2]
        self.near = np.concatenate(pair, axis=2).reshape(self.size**2, -1).astype(np.float32)
        self.far = np.concatenate(tail, axis=2).reshape(self.size**2, -1).astype(np.float32)
        self.short = FILTERS * sum(w == 2 for w in WIDTHS)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Of folded windows (n, WINDOW)."""
        codes = self.code[windows].astype(np.int32)
        pairs = codes[:, :-1] * self.size + codes[:, 1:]
        out = []
        for at in range(0, len(pairs), POOLED):
            here = pairs[at:at + POOLED]
            near = self.near[here]
            both = near[:, :-2, self.short:] + self.far[here[:, 2:]]
            # a width of three ends one position later than a width of four: its last place uses the pair's first byte
            last = near[:, -2, self.short:self.short + FILTERS] + self.last(codes[at:at + POOLED])
            pooled = np.concatenate([near[:, :, : self.short].max(axis=1), both.max(axis=1)], axis=1)
            np.maximum(pooled[:, self.short:self.short + FILTERS], last, out=pooled[:, self.short:self.short + FILTERS])
            out.append(pooled)
        hidden = np.maximum(np.concatenate(out) + self.net.bias, 0)
        return softmax(hidden @ self.net.out + self.net.out_bias)

    def last(self, codes: np.ndarray) -> np.ndarray:
        """The third tap of the width-three filters on a window's last byte."""
        return self.far[codes[:, -1] * self.size, :FILTERS]

    def classify(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        windows = [cut_windows(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in windows])
        found = np.concatenate(windows)
        share = (found != 0).sum(axis=1, keepdims=True) + 1e-6
        total = np.zeros((len(texts), len(self.net.labels)))
        for at in range(0, len(found), 64 * POOLED):
            np.add.at(total, owner[at:at + 64 * POOLED], self.probabilities(found[at:at + 64 * POOLED]) * share[at:at + 64 * POOLED])
        total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
        best = total.argmax(axis=1)
        return [self.net.labels[b] for b in best], total[np.arange(len(texts)), best]


def ready(docs: DataFrame, *columns: Column) -> DataFrame:
    """The given columns with text and letters: whether the text has any."""
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(*columns, "text", letters.alias("letters"))


def classified(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches with the language and score of their rows."""
    let_go()
    predictor = Predictor(net)
    for part in slices(batches):
        texts = bytes_of(part)
        rows = np.flatnonzero(part.column("letters").to_numpy(zero_copy_only=False))
        lang, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
        if len(rows):
            lang[rows], score[rows] = predictor.classify([texts[i] for i in rows])
        yield part, lang, score


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): a language for every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, lang, score in classified(batches, net):
            columns = [part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score)]
            yield pa.record_batch(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    rows = ready(docs, F.col("doc_id"), F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"))
    if net is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(run, f"doc_id {id_type(docs)}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Train on the training fold, predict everything."""
    return predict(docs, train(sample(docs)))


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Rows, all columns, whose text has a language with at least the given score; without labels to learn from, rows with a letter."""
    net = train(sample(docs))
    rest = F.struct(*(F.col(c) for c in docs.columns if c != "text")).alias("rest")
    rows = ready(docs, rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, lang, score in classified(batches, net):
            yield part.select(["rest", "text"]).filter(pa.array((lang != UNKNOWN) & (score >= least)))

    if net is None:
        kept = rows.where("letters")
    else:
        kept = rows.mapInArrow(run, StructType([rows.schema["rest"], StructField("text", StringType())]))
    return kept.select(*("text" if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns))
