"""Token counts by a compiled finite-state transducer.

A byte-level BPE vocabulary is compiled, as texts ask for it, into a deterministic transducer over the bytes of
a piece. A state is what the next bytes can still depend on: the last bytes, and for each position in them the
last token of the encoding up to there with its token count, relative to the present one. A transition is
annotated with the change of the count, so a piece's tokens are the sum along its path. That each position has
exactly one such last token rests on a property of BPE: a token sequence is an encoding if and only if each
neighbouring pair encodes to itself.

Long texts are cut into chunks at any place, which are dealt to all tasks. A chunk's state map says what it does to
whatever state the text before it left: it is the part before its first safe boundary (where the character class
changes, a piece ends in every state), the tokens between its first and last one, and the part after, which is
the state it leaves. Maps compose associatively: rounds of a parallel scan compose FAN neighbours each, so no row
gathers a document. Only the last value of the scan is a total, so only its upward rounds are run. A map is as long as the
text's longest run of one character class, which is a single piece that the library, too, has to see whole.

Defined results: a null text is empty and has no tokens; repeated rows are counted one by one; columns other
than doc_id and text are ignored; texts of any length are counted whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.pieces import APOSTROPHE, LETTER, SPACE, UNKNOWN, Cutter, Remembered, batches, byte_letters
from waymark.llm.staging import Stage

CHUNK_CHARS = 32_768
#: Neighbouring maps composed in one round.
FAN = 8
#: A transducer with more states is started anew; remembered pieces stay.
MAX_STATES = 80_000


class Transducer:
    """A byte-level BPE vocabulary as a deterministic machine that counts tokens."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        if len(vocab) > 1 << 16:
            raise ValueError("ids don't fit 16 bits")
        self.vocab, self.longest = vocab, max(map(len, vocab))
        #: for each token the merge that makes it (-1: a byte) and its two parts
        self.made, self.left, self.right = {i: -1 for i in vocab.values()}, {}, {}
        self.rank: dict[int, int] = {}
        for r, (a, b) in enumerate(merges):
            x, y, both = vocab[a], vocab[b], vocab[a + b]
            self.rank[x << 16 | y] = r
            self.made[both], self.left[both], self.right[both] = r, x, y
        self.pairs: dict[int, bool] = {}
        self._clear()

    @classmethod
    def load(cls, path: str) -> Transducer:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return cls(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])

    def _clear(self) -> None:
        #: letters seen, last token at each position from the present one back (-1: the start), and the counts
        #: there relative to the present one
        self.states: list[tuple[str, tuple, tuple]] = [("", (-1,), (0,))]
        self.arcs: dict[tuple[int, str], tuple[int, int]] = {}

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether a, b is the encoding of their bytes: going back in time from the two finished tokens, no
        merge joins their touching ends before one of the ends is itself merged."""
        key = a << 16 | b
        before, ok = len(self.rank), True
        while True:
            joined = self.rank.get(a << 16 | b)
            if joined is not None and joined < before:
                ok = False
                break
            ra, rb = self.made[a], self.made[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                before, a = ra, self.right[a]
            else:  # of equal merges the left one is made first
                before, b = rb + 1, self.left[b]
        self.pairs[key] = ok
        return ok

    def _compile(self, state: int, letter: str) -> tuple[int, int]:
        """Adds the transition from state by one byte; its target and the change of the token count."""
        seen, last, rel = self.states[state]
        seen += letter
        get, pairs = self.vocab.get, self.pairs
        for n in range(1, min(len(seen), self.longest) + 1):
            token = get(seen[-n:])
            if token is not None:
                a = last[n - 1]
                ok = True if a < 0 else pairs.get(a << 16 | token)
                if ok or ok is None and self._may_follow(a, token):
                    break
        else:
            raise ValueError("no token fits")
        step = rel[n - 1] + 1
        keep = self.longest
        back = tuple([r - step for r in rel[:keep]]) if step else rel[:keep]
        self.states.append((seen[-keep:], (token, *last[:keep]), (0, *back)))
        arc = self.arcs[state, letter] = (len(self.states) - 1, step)
        return arc

    def count(self, letters: str) -> int:
        """Tokens of a piece, given as letters of the vocabulary."""
        if len(self.states) > MAX_STATES:
            self._clear()
        state, total = 0, 0
        for letter in letters:
            arc = self.arcs.get((state, letter)) or self._compile(state, letter)
            state, total = arc[0], total + arc[1]
        return total

    def count_all(self, pieces: list[str]) -> list[int]:
        """In sorted order, so that pieces with a common beginning share its states."""
        letters = byte_letters(pieces)
        out = [0] * len(pieces)
        for i in sorted(range(len(pieces)), key=letters.__getitem__):
            out[i] = self.count(letters[i])
        return out


class Counter:
    """Token counts of texts without special strings."""

    def __init__(self, path: str):
        self.path = path

    @cached_property
    def cutter(self) -> Cutter:
        return Cutter(spaced=True)

    @cached_property
    def library(self):
        """For texts with code points that Python's tables don't know."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def remembered(self) -> Remembered:
        machine = Transducer.load(self.path)
        return Remembered(lambda pieces: (np.array(machine.count_all(pieces), "<u4").view(np.uint16), [2] * len(pieces)))

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for a, b in batches(texts):
            cut = self.cutter.cut(texts[a:b])
            values, at = self.remembered.runs(cut)
            total = np.concatenate(([0], np.cumsum(values.view(np.uint32), dtype=np.int64)))
            found = (total[at[1:] // 2] - total[at[:-1] // 2]).tolist()
            for i in np.flatnonzero(cut.unknown).tolist():
                found[i] = len(self.library.encode(texts[a + i], add_special_tokens=False).ids)
            out += found
        return out


#: A chunk's state map: (open, head, count, tail). Open: there is no safe boundary, head is the whole chunk.
Map = tuple[bool, str, int, str]


def safe_boundaries(cutter: Cutter, text: str) -> np.ndarray:
    """Places within a text where a piece ends whatever stands around it: the class changes, but not after white space,
    of which the last may join what follows, nor between an apostrophe and a letter."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    k = cutter.table[codes]
    a, b = k[:-1], k[1:]
    safe = (a != b) & (a != SPACE) & (a != UNKNOWN) & (b != UNKNOWN) & ~((codes[:-1] == APOSTROPHE) & (b == LETTER))
    return np.flatnonzero(safe) + 1


def state_maps(counter: Counter, chunks: list[str]) -> list[Map]:
    parts, middles = [], []
    for text in chunks:
        at = safe_boundaries(counter.cutter, text)
        if not len(at):
            parts.append((True, text, ""))
            continue
        parts.append((False, text[: at[0]], text[at[-1] :]))
        middles.append(text[at[0] : at[-1]])
    found = iter(counter.counts(middles))
    return [(True, h, 0, "") if o else (False, h, next(found), t) for o, h, t in parts]


def compose(counter: Counter, a: Map, b: Map) -> Map:
    """The map of two neighbouring chunks."""
    if a[0] and b[0]:
        return (True, a[1] + b[1], 0, "")
    if a[0]:
        return (False, a[1] + b[1], b[2], b[3])
    if b[0]:
        return (False, a[1], a[2], a[3] + b[1])
    return (False, a[1], a[2] + counter.counts([a[3] + b[1]])[0] + b[2], b[3])


def finish(counter: Counter, m: Map) -> int:
    """Tokens of a whole segment with this map."""
    return sum(counter.counts([m[1], m[3]])) + m[2]


_COUNTERS: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    """One machine for all the tasks of a Python worker."""
    return _COUNTERS.setdefault(path, Counter(path))


KEYS, MAP = ("row", "doc_id", "n_bytes", "segment", "part"), ("open", "head", "count", "tail")
_MAPS = "row long, doc_id long, n_bytes long, segment int, part int, open boolean, head string, count long, tail string"


def _with_maps(batch: pa.RecordBatch, maps: list[Map]) -> pa.RecordBatch:
    columns = list(zip(*maps, strict=True)) or [()] * 4
    kinds = (pa.bool_(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([batch.column(k) for k in KEYS] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*KEYS, *MAP])


def _map_chunks(path: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in it:
            yield _with_maps(batch, state_maps(counter, batch.column("chunk").to_pylist()))

    return run


def _compose_maps(path: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in it:
            out = []
            for maps in batch.column("maps").to_pylist():
                now, *others = [tuple(m[k] for k in MAP) for m in maps]
                for m in others:
                    now = compose(counter, now, m)
                out.append(now)
            yield _with_maps(batch, out)

    return run


def _finish_maps(path: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in it:
            maps = zip(*(batch.column(k).to_pylist() for k in MAP), strict=True)
            totals = pa.array([finish(counter, m) for m in maps], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in KEYS[:3]] + [totals], names=[*KEYS[:3], "n"])

    return run


def _count_whole(path: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in it:
            totals = pa.array(counter.counts(batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), totals], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def special_pattern(path: str) -> str:
    """A pattern of the special strings that the vocabulary's file lists; the longest first."""
    with open(path, encoding="utf-8") as f:
        found = sorted((t["content"] for t in json.load(f)["added_tokens"]), key=len, reverse=True)
    return "|".join(map(re.escape, found)) or "(?!)"


def scanned(maps: DataFrame, parts: int, path: str) -> DataFrame:
    """One map for each segment, by rounds that compose FAN neighbours; parts: chunks of the longest segment."""
    while parts > 1:
        group = maps.groupBy("row", "doc_id", "n_bytes", "segment", F.floor(F.col("part") / FAN).cast("int").alias("part"))
        lists = group.agg(F.sort_array(F.collect_list(F.struct(F.col("part").alias("at"), *MAP))).alias("maps"))
        maps, parts = lists.mapInArrow(_compose_maps(path), _MAPS), -(-parts // FAN)
    return maps


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every whole text. The special strings of the vocabulary count one token each
    time. Short texts are counted where they are read; only the chunks of long ones are shuffled."""
    special, whole = special_pattern(path), F.coalesce("text", F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole.alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    plain = (F.length("text") <= CHUNK_CHARS) & ~F.col("text").rlike(special)
    short = rows.filter(plain).select("doc_id", "n_bytes", "text").mapInArrow(_count_whole(path), "doc_id long, n_bytes long, n_tokens long")
    segments = rows.filter(~plain).select("row", "doc_id", "n_bytes", F.posexplode(F.split("text", special)).alias("segment", "t"))
    chunks = segments.select("row", "doc_id", "n_bytes", "segment", F.posexplode_outer(F.regexp_extract_all("t", F.lit(f"(?s).{{1,{CHUNK_CHARS}}}"), 0)).alias("part", "chunk"))
    chunks = chunks.withColumns({"part": F.coalesce("part", F.lit(0)), "chunk": F.coalesce("chunk", F.lit(""))})
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.repartition(n, "row", "segment", "part")
    maps = Stage(docs.sparkSession, "token-counts").write(dealt.mapInArrow(_map_chunks(path), _MAPS), "maps")
    longest = maps.agg(F.max("part")).first()[0]
    one = scanned(maps, (longest or 0) + 1, path).mapInArrow(_finish_maps(path), "row long, doc_id long, n_bytes long, n long")
    # each special string stands between two segments and is one token
    long = one.groupBy("row", "doc_id", "n_bytes").agg((F.sum("n") + F.count("*") - 1).alias("n_tokens"))
    return short.unionByName(long.drop("row"))
