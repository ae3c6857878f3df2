"""Packing token ids into windows by lexical retrieval.

Full windows of a long document stand alone; what is left of each document is packed. The index is sharded by documents:
rests are sorted by their most characteristic id (of highest BM25-like weight, an id's rank in the vocabulary standing
for its rarity) and then by a min-hash, and each SHARD_DOCS neighbours in that order, texts on one subject and near copies,
are a shard with an inverted index. Its BM25 weights are those of the corpus: document frequencies, the number of rests
and their mean length are counted over all rests. A seed document asks its shard with all its ids for its unused
neighbours, which fill the seed's window greedily, best first. The last one is cut where the window ends and its remainder
seeds the next window. When a partition ends, its last open window is cut into windows of powers of two, so nothing is padded.

A shard's memory is bounded whatever the number of equal documents. Text is encoded once, into a staged table; the
range partitioning samples that table.

Defined results: a null text is empty and consists of the end id; repeated rows and null ids are packed like any
document; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.pieces import trim
from waymark.llm.staging import Stage, shrink
from waymark.llm.token_store import encoder, forget

WINDOW = 2048
SHARD_DOCS = 1024
#: Neighbours sorted at first; the others follow if those don't fill the window.
NEIGHBOURS = 16
K1, B = 1.2, 0.75

_ENCODED = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long, lex long, ids binary, counts binary"
_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def crc_of(ids: np.ndarray) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


#: Rarity that an id's rank in the vocabulary lets expect.
_RARITY = np.log1p(np.arange(1 << 16))


class Described(NamedTuple):
    """Of each rest the id that characterises it most and the least hash of its neighbouring pairs of ids; of all together how many hold
    each id."""

    subject: np.ndarray
    min_hash: np.ndarray
    df: np.ndarray


def describe(rests: list[np.ndarray]) -> Described:
    """All rests, none of them empty, at once."""
    lengths = np.fromiter(map(len, rests), np.int64, len(rests))
    flat, starts = np.concatenate(rests), np.cumsum(lengths) - lengths
    key = np.repeat(np.arange(len(rests), dtype=np.int64), lengths) << 16 | flat
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    doc, term, tf = key[first] >> 16, key[first] & 0xFFFF, np.diff(np.append(first, len(key)))
    weight = _RARITY[term] * tf / (tf + K1)
    most = np.maximum.reduceat(weight, np.searchsorted(doc, np.arange(len(rests))))
    hit = np.flatnonzero(weight == most[doc])
    subject = term[hit[np.unique(doc[hit], return_index=True)[1]]]
    h = flat.astype(np.uint32) * np.uint32(2654435761)
    mixed = h.copy()
    mixed[:-1] = (h[:-1] * np.uint32(31) + h[1:]) * np.uint32(0x85EBCA6B)
    ends = starts + lengths - 1
    mixed[ends] = h[ends]
    mixed ^= mixed >> np.uint32(15)
    mixed[ends[lengths > 1]] = np.uint32(0xFFFFFFFF)  # the last id begins no pair
    return Described(subject, np.minimum.reduceat(mixed, starts), np.bincount(term, minlength=1 << 16))


def _encode(path: str, end_id: int):
    names = ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens", "lex", "ids", "counts"]
    kinds = [pa.int64()] * 7 + [pa.binary()] * 2

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder(path).encode, np.array([end_id], "<u2").tobytes()
        df, n_rests, n_ids = np.zeros(1 << 16, np.int64), 0, 0
        for batch in it:
            full, left, rests = [], [], []
            ids_of = encode(batch.column("text").to_pylist())
            for doc, row, raw in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), ids_of, strict=True):
                ids = np.frombuffer(raw + tail, "<u2")
                n = len(ids)
                for at in range(0, n - WINDOW + 1, WINDOW):
                    full.append((doc, row, at, WINDOW, crc_of(ids[at : at + WINDOW]), n, 0, None, None))
                at = n - n % WINDOW
                if at < n:
                    left.append((doc, row, at, n - at, None, n))
                    rests.append(ids[at:])
            if rests:
                found = describe(rests)
                lex = found.subject << 32 | found.min_hash.astype(np.int64)
                full += [(*x, y, ids.tobytes(), None) for x, y, ids in zip(left, lex.tolist(), rests, strict=True)]
                df, n_rests, n_ids = df + found.df, n_rests + len(rests), n_ids + sum(map(len, rests))
            columns = list(zip(*full, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        terms = np.flatnonzero(df)
        if n_rests:  # what the task has counted
            counted = [None, None, n_rests, n_ids, None, None, -1, terms.astype("<u2").tobytes(), df[terms].astype("<i8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(counted, kinds, strict=True)], names=names)
        trim()

    return run


class Stats(NamedTuple):
    """What BM25 asks of a corpus: how many documents, their mean length, and each id's share of them."""

    n: int
    mean: float
    df: np.ndarray


def _count_partition(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): documents by id, and at -1 and -2 all documents and their length; one row of counts for each task that encoded."""
    df, n, total = np.zeros(1 << 16, np.int64), 0, 0
    for batch in it:
        for terms, counts, docs, ids in zip(*(batch.column(c).to_pylist() for c in ("ids", "counts", "start", "length")), strict=True):
            df[np.frombuffer(terms, "<u2")] += np.frombuffer(counts, "<i8")
            n, total = n + docs, total + ids
    terms = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((terms, [-1, -2]))), pa.array(np.concatenate((df[terms], [n, total])))], names=["term", "n"])


def corpus_stats(encoded: DataFrame) -> Stats:
    """Stats of all rests; ids are of 16 bits, so at most 65,538 rows reach the driver."""
    counted = encoded.filter("counts is not null").select("ids", "counts", "start", "length").mapInArrow(_count_partition, "term long, n long")
    found = dict(counted.groupBy("term").agg(F.sum("n")).collect())
    n, total, df = found.pop(-1, 0), found.pop(-2, 0), np.zeros(1 << 16, np.int64)
    df[list(found)] = list(found.values())
    return Stats(n, max(1.0, total / max(1, n)), df)


class Shard:
    """An inverted index over the ids of some documents, with BM25 weights of the corpus that they belong to; without its
    stats they are the corpus."""

    def __init__(self, docs: list[np.ndarray], stats: Stats | None = None):
        n = len(docs)
        lengths = np.array([len(d) for d in docs])
        key = np.repeat(np.arange(n, dtype=np.int64), lengths) << 16 | np.concatenate(docs)
        pairs, tf = np.unique(key, return_counts=True)
        self.term, self.doc = pairs & 0xFFFF, pairs >> 16
        self.bounds = np.searchsorted(self.doc, np.arange(n + 1))
        stats = stats or Stats(n, max(1.0, lengths.mean()), np.bincount(self.term, minlength=1 << 16))
        idf = np.log1p((stats.n - stats.df + 0.5) / (stats.df + 0.5))
        norm = K1 * (1 - B + B * lengths / stats.mean)
        self.weight = idf[self.term] * tf * (K1 + 1) / (tf + norm[self.doc])
        order = np.argsort(self.term, kind="stable")
        self.by_term, self.by_doc, self.by_weight = self.term[order], self.doc[order], self.weight[order]
        self.used, self.live = np.zeros(n, bool), n
        self._bound()

    def _bound(self) -> None:
        self.postings = np.concatenate(([0], np.cumsum(np.bincount(self.by_term, minlength=1 << 16))))

    def _compact(self) -> None:
        """Drops the postings of used documents, which no query asks for."""
        keep = ~self.used[self.by_doc]
        self.by_term, self.by_doc, self.by_weight = self.by_term[keep], self.by_doc[keep], self.by_weight[keep]
        self._bound()

    def neighbours(self, seed: int) -> Iterator[int]:
        """All unused documents that share an id, by descending score, ties by place."""
        left = len(self.used) - int(np.count_nonzero(self.used))
        if left < self.live / 2:
            self.live = left
            self._compact()
        terms = self.term[self.bounds[seed] : self.bounds[seed + 1]]
        spans = [(self.postings[t], self.postings[t + 1]) for t in terms.tolist()]
        hits = np.concatenate([self.by_doc[x:y] for x, y in spans])
        score = np.bincount(hits, np.concatenate([self.by_weight[x:y] for x, y in spans]), len(self.used))
        score[self.used] = 0
        found = np.flatnonzero(score > 0)
        if len(found) > NEIGHBOURS:
            least = np.partition(score[found], -NEIGHBOURS)[-NEIGHBOURS]
            first, found = found[score[found] >= least], found[score[found] < least]
            yield from first[np.lexsort((first, -score[first]))].tolist()
        yield from found[np.lexsort((found, -score[found]))].tolist()


class Packer:
    """Windows of one partition, over its shards in order."""

    def __init__(self, first_id: int, stats: Stats):
        self.stats = stats
        self.id, self.out, self.open, self.room = first_id, [], [], WINDOW

    def _emit(self, pieces: list[tuple], size: int) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), crc_of(ids), total, self.id, at))
            at += len(ids)
        assert at == size
        self.id += 1

    def full(self, doc, start: int, length: int, crc: int, total: int) -> None:
        self.out.append((doc, start, length, crc, total, self.id, 0))
        self.id += 1

    def _place(self, piece: tuple) -> tuple | None:
        """Puts a piece into the open window; what doesn't fit comes back."""
        doc, start, ids, total = piece
        take = min(self.room, len(ids))
        self.open.append((doc, start, ids[:take], total))
        self.room -= take
        if not self.room:
            self._emit(self.open, WINDOW)
            self.open, self.room = [], WINDOW
        return (doc, start + take, ids[take:], total) if take < len(ids) else None

    def shard(self, pieces: list[tuple]) -> None:
        """Packs a shard's rests; the window that stays open goes on in the next shard."""
        if not pieces:
            return
        index, used, next_up = Shard([p[2] for p in pieces], self.stats), None, 0
        used = index.used
        seed = None
        while True:
            if seed is None:
                while next_up < len(pieces) and used[next_up]:
                    next_up += 1
                if next_up == len(pieces):
                    return
                seed = next_up
                used[seed] = True
                if (rest := self._place(pieces[seed])) is not None:
                    self._place(rest)
            carried = None
            for near in index.neighbours(seed):
                used[near] = True
                filled_by, rest = near, self._place(pieces[near])
                if rest is not None:
                    self._place(rest)
                if rest is not None or self.room == WINDOW:
                    carried = filled_by if rest is not None else None
                    break
            seed = carried

    def close(self) -> None:
        """Cuts the open window into windows of powers of two."""
        pieces, left = self.open, WINDOW - self.room
        self.open, self.room = [], WINDOW
        while left:
            size = 1 << (left.bit_length() - 1)
            now, need, rest = [], size, []
            for doc, start, ids, total in pieces:
                take = min(need, len(ids))
                if take:
                    now.append((doc, start, ids[:take], total))
                if take < len(ids):
                    rest.append((doc, start + take, ids[take:], total))
                need -= take
            self._emit(now, size)
            pieces, left = rest, left - size

    def drain(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [()] * 7
        self.out = []
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _pack_partition(stats: Stats):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        packer, waiting = Packer(TaskContext.get().partitionId() << 40, stats), []
        for batch in it:
            for doc, start, length, crc, total, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")), strict=True):
                if ids is None:
                    packer.full(doc, start, length, crc, total)
                    continue
                waiting.append((doc, start, np.frombuffer(ids, "<u2"), total))
                if len(waiting) == SHARD_DOCS:
                    packer.shard(waiting)
                    waiting = []
            if packer.out:
                yield packer.drain()
        packer.shard(waiting)
        packer.close()
        yield packer.drain()

    return run


def pack(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    shrink(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    stage = Stage(spark, "packing")
    # small batches: a worker holds a batch's texts, their ids and its rows beside the encoder; each task adds a row of what it has counted
    encoded = stage.write(rows.mapInArrow(_encode(path, end_id), _ENCODED), "ids", batch="2m")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # full windows have lex 0 and no ids; row and start break ties, so equal documents spread over partitions
    dealt = encoded.filter("counts is null").drop("counts").repartitionByRange(n, "lex", "row", "start").sortWithinPartitions("lex", "row", "start")
    return dealt.mapInArrow(_pack_partition(corpus_stats(encoded)), _PACKED)
