"""Token ids of whole texts through a bounded table of their space-separated pieces.

Byte-level and word-end BPE vocabularies split a text before every single space
that follows a non-space character, so a text's ids are those of its pieces,
one after the other.  All pieces of a slice of texts are hashed and looked up
with array operations; only pieces that a worker has not seen are tokenized.
Pieces are told apart by 64-bit hashes: among the at most ``KEPT`` pieces of a
table two are taken for one another with a chance below one in a million.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np
from tokenizers import Tokenizer

from batchlens.llm import rolling
from batchlens.llm.common import held

#: Pieces a worker keeps; the table starts anew beyond.
KEPT = 1_500_000
_SLOTS = 1 << 22
#: Letters that case folding and composition leave one letter each; ASCII signs other than the apostrophe.
_L, _P = "A-Za-zÀ-ÖØ-öø-įĲ-ſ", r"!-&(-/:-@\[-`{-~"
#: Runs of a piece made of these and of single line ends.
RUNS = re.compile(rf"[{_L}]+|[0-9]+|[{_P}]+|\n")
RUNS_FOLDED = re.compile(rf"[{_L}]+|[0-9]|[{_P}]+|\n")
#: The usual piece: a space, a word, and perhaps signs.
USUAL = re.compile(rf"( [{_L}]+)([{_P}]*)")
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[*range(9, 14), *range(28, 33)]] = True
_DRAWN = np.random.default_rng(11).integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def cut(raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """First byte of each piece of joined texts: text starts, and single spaces after a character that isn't white space."""
    start = np.zeros(len(raw) + 1, dtype=bool)
    space = np.flatnonzero(raw == 32)
    space = space[space > 0]
    one, two, three = raw[space - 1], raw[space - 2], raw[space - 3]
    # white space beyond ASCII ends in two or three bytes like these; characters that merely look like it only make a longer piece
    loose = _WHITE[one] | ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three >= 0xE1) & (three <= 0xE3) & ((two == 0x80) | (two == 0x81) | (two == 0x9A)))
    start[space[~loose]] = True
    start[begins] = True
    return np.flatnonzero(start[:-1])


def piece_hashes(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    place = np.arange(len(raw)) - np.repeat(starts, sizes)
    values = _DRAWN[0][raw] * _DRAWN[1][place & 255]
    if sizes.max() > 256:  # multipliers repeat in long pieces; the round number keeps their later bytes apart
        late = np.flatnonzero(place >= 256)
        values[late] = rolling.mix(values[late] + (place[late] >> 8).astype(np.uint64))
    return rolling.mix(np.add.reduceat(values, starts) + sizes.astype(np.uint64))


class PieceTable:
    """Ids of pieces; ``learn`` gives those of new ones as little-endian 32-bit bytes."""

    def __init__(self, learn: Callable[[list[bytes]], list[bytes]]):
        self.learn = learn
        self._clear()

    def _clear(self) -> None:
        self.keys, self.entry = np.zeros(_SLOTS, dtype=np.uint64), np.full(_SLOTS, -1, dtype=np.int32)
        self.ids, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.first, self.count, self.known = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int32), 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where it is new."""
        found = np.full(len(hashes), -1, dtype=np.int32)
        open_, slot = np.arange(len(hashes)), (hashes & np.uint64(_SLOTS - 1)).astype(np.int64)
        while len(open_):
            entry = self.entry[slot]
            hit = (self.keys[slot] == hashes[open_]) & (entry >= 0)
            found[open_[hit]] = entry[hit]
            on = ~hit & (entry >= 0)
            open_, slot = open_[on], (slot[on] + 1) & (_SLOTS - 1)
        return found

    def _add(self, hashes: np.ndarray, made: list[bytes]) -> None:
        """Enter new, distinct hashes."""
        sizes = np.fromiter(map(len, made), dtype=np.int64, count=len(made)) // 4
        ids = np.frombuffer(b"".join(made), dtype="<u4")
        n, u = self.known, self.used
        while u + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(made) > len(self.first):
            self.first, self.count = np.concatenate([self.first, np.zeros_like(self.first)]), np.concatenate([self.count, np.zeros_like(self.count)])
        self.ids[u:u + len(ids)] = ids
        self.first[n:n + len(made)], self.count[n:n + len(made)] = u + np.cumsum(sizes) - sizes, sizes
        self.used, self.known = u + len(ids), n + len(made)
        todo, slot = np.arange(len(made)), (hashes & np.uint64(_SLOTS - 1)).astype(np.int64)
        while len(todo):
            _, winner = np.unique(slot, return_index=True)
            winner = winner[self.entry[slot[winner]] < 0]
            self.keys[slot[winner]], self.entry[slot[winner]] = hashes[todo[winner]], n + todo[winner]
            on = np.ones(len(todo), dtype=bool)
            on[winner] = False
            todo, slot = todo[on], (slot[on] + 1) & (_SLOTS - 1)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and where each text's ids end."""
        data = b"".join(texts)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        if not data:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
        raw, begins = np.frombuffer(data, dtype=np.uint8), np.cumsum(sizes) - sizes
        starts = cut(raw, begins)
        hashes = piece_hashes(raw, starts, np.diff(starts, append=len(raw)))
        if self.known > KEPT:
            self._clear()
        entry = self._find(hashes)
        new = np.flatnonzero(entry < 0)
        if len(new):
            distinct, at, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            ends = np.append(starts, len(raw))
            known = self.known
            self._add(distinct, self.learn([data[starts[i]:ends[i + 1]] for i in new[at].tolist()]))
            entry[new] = known + back
        count = self.count[entry].astype(np.int64)
        done = np.cumsum(count)
        spots = np.repeat(self.first[entry] - (done - count), count) + np.arange(int(done[-1]))
        last = np.searchsorted(starts, begins + sizes) - 1  # last piece of each text; that of the text before if it is empty
        return self.ids[spots], np.where(last >= 0, done[last], 0)


def byte_letters() -> list[str]:
    """The printable letter byte-level vocabularies use for each byte: printable bytes stand for themselves, others follow from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


LETTERS = byte_letters()


class TextCoder:
    """Ids by a file of the tokenizers library.

    Runs of plain letters, digits and ASCII signs go straight to the library's
    BPE model, and runs are shared between pieces; any other piece goes through
    the library's whole tokenizer.
    """

    #: Runs kept while new pieces are learnt.
    RUNS_KEPT = 200_000

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # such strings in a text are ordinary text
        self.model = self.library.model
        self.folded = self.library.normalizer is not None  # lower-cases and drops white space
        self.cut = (RUNS_FOLDED if self.folded else RUNS).findall
        self.runs: dict[str, bytes] = {}
        self.table = PieceTable(self._learn)

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.runs) > self.RUNS_KEPT:
            self.runs = {}
        return [self._piece(p.decode("utf-8", "replace")) for p in pieces]

    def _piece(self, piece: str) -> bytes:
        plain = piece.lower() if self.folded else piece
        if usual := USUAL.fullmatch(plain):
            word, signs = usual.groups()
            if self.folded:
                word = word[1:]
            ids = self.runs.get(word) or self._run(word)
            return ids + (self.runs.get(signs) or self._run(signs)) if signs else ids
        spaced = plain[0] == " "
        runs = self.cut(plain, spaced)
        if sum(map(len, runs)) + spaced != len(plain) or not runs or "\n\n" in plain or runs[0] == "\n" or runs[-1] == "\n":
            return array("I", self.library.encode(piece, add_special_tokens=False).ids).tobytes()
        if spaced and not self.folded:
            runs[0] = " " + runs[0]
        return b"".join([self.runs.get(r) or self._run(r) for r in runs])

    def _run(self, run: str) -> bytes:
        if self.folded and run == "\n":
            return b""
        mapped = run if run.isascii() and run[0] not in " \n" else "".join(map(LETTERS.__getitem__, run.encode()))
        found = self.runs[run] = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return found

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.table.encode(texts)


def coder(path: str) -> TextCoder:
    """One coder per file and worker process."""
    return held(("words", path), lambda: TextCoder(path))
