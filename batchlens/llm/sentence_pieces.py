"""SentencePiece BPE encoding that keeps the source bytes of every piece.

A text is normalised by longest prefixes of the model's compiled character map
(``charmap``), which records the source of each normalised byte.  No piece of
such a vocabulary has a space sign after another character, so the normalised
text is cut before every space sign that follows one; new parts are merged by
the library, whose own normalisation is off, and their ids are kept in a
worker's bounded table.  Piece borders are
projected through the record to byte spans of the original text.

Defined results: null and empty texts have the begin and end ids alone; repeated
rows give repeated results; null ids are kept; an empty table gives an empty
result; columns other than id and text are ignored; strings of control pieces
inside texts are ordinary text.  Characters outside the vocabulary become byte
pieces, the last of which carries the character's span.  Models other than BPE
with byte fallback are refused.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from batchlens.llm.charmap import CharMap
from batchlens.llm.common import bytes_of, held, id_type, slices
from batchlens.llm.words import PieceTable

#: Texts are encoded in slices of this many bytes.
SLICE = 4 << 20
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)


class Encoded(NamedTuple):
    """Ids of joined texts, the source bytes [begin, end) of each, and where each text's ids end."""

    ids: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    stops: np.ndarray


class Model:
    """Pieces, scores and character map of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            content = file.read()
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(content)
        how, norm = spec.trainer_spec, spec.normalizer_spec
        kinds = {p.type for p in spec.pieces}
        if how.model_type != how.BPE or not how.byte_fallback or kinds & {USER, UNUSED} or how.treat_whitespace_as_suffix or not norm.escape_whitespaces:
            raise ValueError("only BPE models with byte fallback, space signs and without user-defined or unused pieces are supported")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self.map = CharMap(norm.precompiled_charsmap, norm.add_dummy_prefix, norm.remove_extra_whitespaces)
        spaced = [p.piece.replace("▁", " ") for p in spec.pieces]
        normal = [i for i, p in enumerate(spec.pieces) if p.type == NORMAL]
        if any(" " in spaced[i].lstrip(" ") or " " in spec.pieces[i].piece for i in normal):
            raise ValueError("a piece has a space after another character")
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        #: Normalised bytes of each id.
        self.width = np.array([len(s.encode()) if p.type == NORMAL else int(p.type == BYTE) for s, p in zip(spaced, spec.pieces, strict=True)], dtype=np.int64)
        self.is_byte = np.array([p.type == BYTE for p in spec.pieces])
        # parts are normalised already: the library only merges them
        norm.precompiled_charsmap, norm.add_dummy_prefix, norm.remove_extra_whitespaces = b"", False, False
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.table = PieceTable(self._learn)

    def _learn(self, parts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of parts of normalised text."""
        return [array("I", ids).tobytes() for ids in self.merger.encode([p.decode() for p in parts], num_threads=1)]

    def encode(self, texts: list[bytes]) -> Encoded:
        """Ids of the texts without begin and end ids, with their byte spans in the texts."""
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        norm = self.map.normalise(np.frombuffer(b"".join(texts), dtype=np.uint8), sizes)
        whole, cuts = norm.raw.tobytes(), [0, *norm.ends.tolist()]
        ids, stops = self.table.encode([whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
        stops = np.maximum.accumulate(stops) if len(stops) else stops
        right = np.cumsum(self.width[ids])
        if (int(right[-1]) if len(right) else 0) != len(whole):
            raise ValueError("pieces don't cover the normalised texts")
        left = right - self.width[ids]
        counts = np.diff(stops, prepend=0)
        text_of = np.repeat(np.arange(len(texts)), counts)
        start, last = norm.raw & 0xC0 != 0x80, np.ones(len(ids), dtype=bool)
        part = np.flatnonzero(self.is_byte[ids])
        if len(part):  # bytes of one character: all begin where it does, the last one ends with it
            lead = np.flatnonzero(start)
            left[part] = lead[np.searchsorted(lead, left[part], side="right") - 1]
            inner = part[right[part] < len(whole)]
            last[inner] = start[right[inner]]
        begin = norm.origin[left] if len(ids) else np.zeros(0, dtype=np.int64)
        inside = right < norm.ends[text_of]
        end = np.where(inside, norm.origin[np.where(inside, right, 0)], norm.stop[text_of]) if len(ids) else begin
        end = np.where(last, end, begin)
        base = (np.cumsum(sizes) - sizes)[text_of]
        return Encoded(ids, begin - base, end - base, stops)

    def framed(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids and spans of each text with begin and end ids, which cover nothing."""
        found, start = self.encode(texts), 0
        for text, stop in zip(texts, found.stops.tolist(), strict=True):
            n, ids = stop - start + 2, found.ids[start:stop]
            out = np.empty((3, n), dtype="<u4")
            out[0, 0], out[0, 1:-1], out[0, -1] = self.bos, ids, self.eos
            out[1, 0], out[1, 1:-1], out[1, -1] = 0, found.begin[start:stop], len(text)
            out[2, 0], out[2, 1:-1], out[2, -1] = 0, found.end[start:stop], len(text)
            yield out[0], out[1], out[2]
            start = stop


def model(path: str) -> Model:
    """One model per file and worker process."""
    return held(("pieces", path), lambda: Model(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, begins, ends): little-endian 32-bit ids and byte spans of every text, begin and end ids included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE):
            found = [[a.tobytes() for a in arrays] for arrays in model(path).framed(bytes_of(part))]
            columns = [pa.array(c, pa.binary()) for c in zip(*found, strict=True)]
            yield pa.record_batch([part.column("doc_id"), *columns], names=["doc_id", "ids", "begins", "ends"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, ids binary, begins binary, ends binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes): every text encoded, and decoded again from its ids.

    ``covered_bytes`` counts the bytes of the text that its pieces' spans hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE):
            made, rows = model(path), []
            for ids, begins, ends in made.framed(bytes_of(part)):
                text = made.library.decode(ids.tolist())
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), int((ends - begins).sum())))
            sizes, ids_sha, decoded_sha, covered = zip(*rows, strict=True)
            columns = [pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string()), pa.array(covered, pa.int64())]
            yield pa.record_batch([part.column("doc_id"), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long")
