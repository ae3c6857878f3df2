"""Cutting texts into the pieces that a byte-level BPE works on, and encoding the distinct pieces.

The two split patterns of the public tokenizers are rules about neighbouring character classes, so whole
batches of texts are cut at once with array operations. Pieces are never made into strings one by one: a batch's
pieces are hashed together, met with those seen before in one look-up and compared with them character by character;
only new ones go through the tokenizers library. This is several times faster than encoding texts one by one.

Python's Unicode tables may be older than the library's. Texts with a code point that Python doesn't know, with a
special string, or with a letter whose lower case depends on its place are left to the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate, pairwise
from typing import NamedTuple

import numpy as np

LETTER, NUMBER, OTHER, SPACE, BREAK, UNKNOWN = range(6)
#: Stands between texts in a joined batch; its positions are known, so texts may contain it as well.
SEPARATOR = "\x00"
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
APOSTROPHE, BLANK = 0x27, 0x20
#: A place where every piece ends: white space after a character that is none.
BOUNDARY = "(?<=[^{0}])(?=[{0}])".format("".join(map(re.escape, map(chr, WHITE_SPACE))))
#: Bounds of what a Python worker remembers, and of the characters that arrays are made for at once.
MAX_PIECES, MAX_PIECE_CHARS, BATCH_CHARS = 300_000, 1 << 22, 1 << 17


def character_classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(0x110000):
        name = unicodedata.category(chr(c))
        k = UNKNOWN if name == "Cn" else kinds.get(name[0])
        if k is not None:
            out[c] = k
    out[WHITE_SPACE] = SPACE
    return out


def _letters() -> np.ndarray:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else the next
    unused one from U+0100."""
    out = np.arange(256, dtype=np.uint32)
    prints = np.isin(out, [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)])
    out[~prints] = 0x100 + np.arange(np.count_nonzero(~prints))
    return out


LETTERS = _letters()


def byte_letters(pieces: Sequence[str]) -> list[str]:
    """Each piece's UTF-8 bytes in the letters of the vocabulary."""
    raw = "".join(pieces).encode()
    letters = LETTERS[np.frombuffer(raw, np.uint8)].astype("<u4").tobytes().decode("utf-32-le")
    lengths = map(len, pieces) if raw.isascii() else (len(p.encode()) for p in pieces)
    ends = list(accumulate(lengths, initial=0))
    return [letters[a:b] for a, b in pairwise(ends)]


class Cutter:
    """Piece starts for one of the two patterns. spaced: a blank joins the piece after it, numbers run on and
    runs of white space are pieces; else white space is dropped and each number stands alone."""

    def __init__(self, spaced: bool):
        self.spaced, self.table = spaced, character_classes()

    def starts(self, codes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
        """Positions where pieces start; those of breaks are among them."""
        k = self.table[codes]
        k[breaks] = BREAK
        before = np.concatenate(([BREAK], k[:-1]))
        after = np.concatenate((k[1:], [BREAK]))
        space = k == SPACE
        start = k != before
        if self.spaced:
            blank_before = np.concatenate(([False], codes[:-1] == BLANK)) & (before == SPACE)
            start &= ~blank_before | space | (k == BREAK)
            # the last of several white spaces stands alone (or joins what follows), unless the text ends there
            start |= space & (before == SPACE) & (after != SPACE) & (after != BREAK)
        else:
            start |= k == NUMBER
        start[breaks] = True
        self._contractions(codes, k, start)
        return np.flatnonzero(start)

    @staticmethod
    def _contractions(codes: np.ndarray, k: np.ndarray, start: np.ndarray) -> None:
        """'s 't 'm 'd 're 've 'll are pieces where an apostrophe starts one."""
        at = np.flatnonzero((codes == APOSTROPHE) & start)
        if not len(at):
            return
        padded = np.concatenate((codes, [0, 0, 0]))
        one, two = padded[at + 1], padded[at + 2]
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for hit, n in ((at[short], 2), (at[long & ~short], 3)):
            for i in range(1, n):
                start[hit + i] = False
            end = hit + n
            end = end[end < len(start)]
            if len(end):
                follows = k[end] == LETTER
                start[end[follows]] = True

    def cut(self, texts: Sequence[str]) -> Cut:
        """The pieces of all texts."""
        joined = SEPARATOR.join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths + 1) - 1
        if not len(codes):
            none = np.zeros(0, np.int64)
            return Cut(joined, codes, none, none.astype(bool), np.zeros(len(texts) + 1, np.int64), np.zeros(len(texts), bool))
        starts = self.starts(codes, ends[:-1])
        keep = np.ones(len(starts), bool)
        keep[np.searchsorted(starts, ends[:-1])] = False
        if not self.spaced:
            keep &= self.table[codes[starts]] != SPACE
        unknown = np.zeros(len(texts), bool)
        if not joined.isascii():
            unknown[np.searchsorted(ends, np.flatnonzero(self.table[codes] == UNKNOWN))] = True
        at = np.concatenate((np.searchsorted(starts, ends - lengths), [len(starts)]))
        return Cut(joined, codes, starts, keep, at, unknown)


class Cut(NamedTuple):
    """A batch of texts: its characters, where pieces start, which of these count, where each text's pieces start and
    end among them, and which texts hold a code point that Python doesn't know."""

    joined: str
    codes: np.ndarray
    starts: np.ndarray
    keep: np.ndarray
    at: np.ndarray
    unknown: np.ndarray


def trim() -> None:
    """Gives memory that a task has freed back to the system: workers live on between tasks, beside each other."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if give_back:
        give_back(0)


def batches(texts: Sequence[str], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit characters, one text at least."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


class Rows:
    """A numpy array that grows at its end."""

    def __init__(self, kind):
        self.n, self.room = 0, np.zeros(1024, kind)

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.room):
            grown = np.zeros(max(5 * len(self.room) // 4, self.n + len(x)), self.room.dtype)
            grown[: self.n] = self.room[: self.n]
            self.room = grown
        self.room[self.n : self.n + len(x)] = x
        self.n += len(x)

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1, ... of each run of sizes[i], one run after the other."""
    total = int(sizes.sum())
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)


class Remembered:
    """Values of pieces, each a run of 16-bit integers, computed in bulk for pieces not seen before. An open hash table
    over all pieces of a batch at once; a hit counts only if all characters agree."""

    def __init__(self, compute: Callable[[list[str]], tuple[list[int], list[int]]]):
        #: gives the values of all pieces, one after the other, and how many each has
        self.compute = compute
        self.clear()

    def clear(self) -> None:
        self.keys, self.entry = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.int32)
        self.chars, self.values = Rows(np.uint32), Rows(np.uint16)
        self.char_at, self.n_chars, self.value_at, self.n_values = (Rows(np.int32) for _ in range(4))
        self.rows = (self.chars, self.values, self.char_at, self.n_chars, self.value_at, self.n_values)
        self.held, self.full = 0, []

    @staticmethod
    def _hash(codes: np.ndarray, starts: np.ndarray, place: np.ndarray, longest: int) -> np.ndarray:
        weight = (np.arange(1, longest + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x2545F4914F6CDD1D)
        weight = (weight ^ (weight >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
        h = np.add.reduceat((codes.astype(np.uint64) + np.uint64(1)) * weight[place], starts)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return np.where(h == 0, np.uint64(1), h)

    def _probe(self, key: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        mask = np.uint64(len(self.keys) - 1)
        out, todo, slot = np.full(len(key), -1, np.int64), np.arange(len(key)), key & mask
        while len(todo):
            seen = self.keys[slot]
            hit = seen == key[todo]
            out[todo[hit]] = self.entry[slot[hit]]
            on = ~hit & (seen != 0)
            todo, slot = todo[on], (slot[on] + np.uint64(1)) & mask
        return out

    def _insert(self, key: np.ndarray, entry: np.ndarray) -> None:
        """Adds keys that are new and distinct."""
        if 2 * (self.held + len(key)) > len(self.keys):
            old = self.keys != 0
            key, entry = np.concatenate((self.keys[old], key)), np.concatenate((self.entry[old], entry))
            size = 1 << (4 * len(key)).bit_length()
            self.keys, self.entry, self.held = np.zeros(size, np.uint64), np.zeros(size, np.int32), 0
        self.held += len(key)
        mask = np.uint64(len(self.keys) - 1)
        slot = key & mask
        while len(key):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            win = free[first]
            self.keys[slot[win]], self.entry[slot[win]] = key[win], entry[win]
            lost = np.ones(len(key), bool)
            lost[win] = False
            key, entry, slot = key[lost], entry[lost], (slot[lost] + np.uint64(1)) & mask

    def _same(self, cut: Cut, sizes: np.ndarray, place: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Whether each piece has the characters of its entry."""
        fits = found >= 0
        fits[fits] = self.n_chars.all[found[fits]] == sizes[fits]
        base = np.zeros(len(found), np.int64)
        base[fits] = self.char_at.all[found[fits]]
        held = self.chars.room
        equal = held[np.minimum(np.repeat(base, sizes) + place, len(held) - 1)] == cut.codes
        return fits & np.logical_and.reduceat(equal, cut.starts)

    def entries(self, cut: Cut) -> np.ndarray:
        """The entry of every piece of a batch, dropped pieces included."""
        if self.full:  # what came on top of the bounds served one batch
            for rows, n in zip(self.rows, self.full, strict=True):
                rows.n = n
        elif self.n_chars.n > MAX_PIECES or self.chars.n > MAX_PIECE_CHARS:
            self.full = [rows.n for rows in self.rows]
        if not len(cut.starts):
            return np.zeros(0, np.int64)
        sizes = np.diff(np.append(cut.starts, len(cut.codes)))
        place = np.arange(len(cut.codes)) - np.repeat(cut.starts, sizes)
        key = self._hash(cut.codes, cut.starts, place, int(sizes.max()))
        found = self._probe(key)
        new = np.flatnonzero(~self._same(cut, sizes, place, found))
        if len(new):
            known: dict[str, int] = {}
            first, at, base = [], [], self.n_chars.n
            for i, a, n in zip(new.tolist(), cut.starts[new].tolist(), sizes[new].tolist(), strict=True):
                k = known.setdefault(cut.joined[a : a + n], len(first))
                if k == len(first):
                    first.append(i)
                at.append(base + k)
            self._remember(list(known), key, found, np.array(first))
            found[new] = at
        return found

    def _remember(self, pieces: list[str], key: np.ndarray, found: np.ndarray, first: np.ndarray) -> None:
        values, counts = self.compute(pieces)
        base, lengths, sizes = self.n_chars.n, np.fromiter(map(len, pieces), np.int64, len(pieces)), np.array(counts, np.int64)
        self.char_at.add(self.chars.n + np.cumsum(lengths) - lengths)
        self.value_at.add(self.values.n + np.cumsum(sizes) - sizes)
        self.chars.add(np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32))
        self.values.add(np.array(values, np.uint16))
        self.n_chars.add(lengths)
        self.n_values.add(sizes)
        if self.full:
            return
        # of pieces with one key the table keeps the first; the others are computed again each time
        fresh = found[first] < 0
        keys, one = np.unique(key[first[fresh]], return_index=True)
        self._insert(keys, (base + np.flatnonzero(fresh))[one])

    def runs(self, cut: Cut) -> tuple[np.ndarray, np.ndarray]:
        """The values of all pieces that count, one after the other, and where each text's start and end among them."""
        found = self.entries(cut)
        sizes = np.where(cut.keep, self.n_values.all[found], 0) if len(found) else found
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return self.values.all[spread(self.value_at.all[found], sizes)], ends[cut.at]


def segments(text: str) -> list[str]:
    """A long text in parts of bounded length, if it has boundaries: its pieces are those of the parts."""
    if len(text) <= 2 * BATCH_CHARS:
        return [text]
    out, at, boundary = [], 0, re.compile(BOUNDARY)
    while len(text) - at > 2 * BATCH_CHARS and (hit := boundary.search(text, at + BATCH_CHARS)):
        out.append(text[at : hit.start()])
        at = hit.start()
    return [*out, text[at:]]


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, as little-endian 16-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if len(spec["model"]["vocab"]) + len(spec["added_tokens"]) > 1 << 16:
            raise ValueError("ids don't fit 16 bits")
        self.library = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        self.lower = spec["normalizer"] is not None
        self.cutter, self.pieces = Cutter(spaced=not self.lower), Remembered(self._piece_ids)

    def _piece_ids(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        found = list(map(self.library.model.tokenize, byte_letters(pieces)))
        return [t.id for tokens in found for t in tokens], list(map(len, found))

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _odd(self, text: str, plain: str) -> bool:
        """Whether a text holds a special string or, before lower-casing, a letter whose lower case depends on its place."""
        return bool(self.special.search(text) or self.lower and ("Σ" in text or self.special.search(plain)))

    def _plain(self, text: str) -> str:
        if not self.lower or text.isascii():
            return text.lower() if self.lower else text
        return unicodedata.normalize("NFC", text).lower()

    def _batch(self, texts: Sequence[str]) -> list[bytes]:
        plain = [self._plain(t) for t in texts]
        odd = [self._odd(t, p) for t, p in zip(texts, plain, strict=True)]
        cut = self.cutter.cut(["" if o else p for p, o in zip(plain, odd, strict=True)])
        ids, at = self.pieces.runs(cut)
        whole = (cut.unknown | np.array(odd, bool)).tolist()
        return [self._whole(t) if o else ids[i:j].tobytes() for t, o, i, j in zip(texts, whole, at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        out: list[bytes] = []
        for a, b in batches(texts):
            parts = segments(texts[a]) if b == a + 1 and not self._odd(texts[a], "") else [""]
            out += [b"".join(x for p in parts for x in self._batch([p]))] if len(parts) > 1 else self._batch(texts[a:b])
        return out
