"""Ranked lexical search by pipelined term partitioning.

The index holds postings of the terms that items use, cut into blocks of BLOCK documents. Terms have owners by rarity: the
first owns those of the fewest documents, the last the most common ones. A bundle is a group of items in one block with its
sparse accumulators, (item, document, score). Bundles pass the owners one after the other: a stage is a cogroup of bundles
and the owner's postings by block, which adds the integer contributions. After each stage the 50th best partial score of an
item, over all blocks, is a lower bound of its 50th best score, as contributions are never negative; a bundle then carries on only
documents that can still reach it with the most that the owners to come could add. Rare terms thus raise the bound before common words are met, and
accumulators stay sparse though a common word is in nearly all documents; no document that could rank is left out. The
last stage gives each bundle's best documents, of which the first are selected.

A document is cut into terms where it is read; only postings move: once to their stage. Blocks bound every task: BLOCK documents and
ITEMS items, whatever the length of a posting list. The vocabulary of the items is given to tasks as a set of up
to VOCABULARY terms; with a larger one all terms are counted and joined with it.

Defined results: a null text has no terms; documents that share a doc_id, and repeated rows, are documents of their own; one without doc_id is
ranked behind those of equal score; items that share an item_id are one item with the terms of all; an item without terms,
or whose terms occur nowhere, has no rows; a document with score 0 isn't ranked; empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.staging import Stage, short
from waymark.llm.text import NOT_ALNUM, lower_ascii, pieces

BLOCK, ITEMS, VOCABULARY = 4096, 256, 200_000
#: An owner's terms occur in at most this part of the documents; the last owner has the rest.
OWNERS = (1 / 1000, 1 / 100, 1 / 10)
UNIT, K1, B1, B2 = 1_000_000_000, 1000, 50, 50
#: Bytes of UTF-8 that are part of a term, with A-Z lower-cased; all others become blanks.
_PART = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_PART).split() if text else []


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once."""
    each = F.explode(F.transform(pieces(F.col("text"), NOT_ALNUM), lower_ascii))
    return items.select("item_id", each.alias("term")).distinct()


def _index(vocabulary: frozenset | None):
    """Cuts a partition's documents into blocks: for each a row of its documents, in the order of their ids, and a row for each term."""

    def rows(block: int, docs: list) -> pa.RecordBatch:
        docs.sort(key=lambda d: (d[0] is None, d[0] or 0))
        posts = defaultdict(lambda: ([], [], []))
        for at, (_, n, counts) in enumerate(docs):
            for term, tf in counts.items():
                for x, out in zip((at, tf, n), posts[term], strict=True):
                    out.append(x)
        columns = {
            "block": [block] * (len(posts) + 1), "term": [None, *(t.decode() for t in posts)], "ids": [[d[0] for d in docs], *([None] * len(posts))],
            "ord": [None, *(p[0] for p in posts.values())], "tf": [None, *(p[1] for p in posts.values())], "n": [[d[1] for d in docs], *(p[2] for p in posts.values())],
        }
        kinds = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns.values(), kinds, strict=True)], names=list(columns))

    def index(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, []
        for batch in it:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                found = terms(text)
                counts = Counter(found if vocabulary is None else filter(vocabulary.__contains__, found))
                held.append((doc_id, len(found), counts))
                if len(held) == BLOCK:
                    yield rows(block, held)
                    block, held = block + 1, []
        if held:
            yield rows(block, held)

    return index


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All elements of lists, and the sizes of the lists."""
    a = column.combine_chunks()
    offsets = a.offsets.to_numpy()
    return a.values.to_numpy()[offsets[0] : offsets[-1]], np.diff(offsets)


def _best(score: np.ndarray, top: int) -> np.ndarray:
    """The first documents of a dense row by score, then by place; only those above 0."""
    some = np.flatnonzero(score)
    if len(some) > top:
        least = np.partition(score[some], len(some) - top)[len(some) - top]
        some = some[score[some] >= least]
    return some[np.lexsort((some, -score[some]))[:top]]


def _stage(n_docs: int, n_terms: int, top: int):
    """Cogroup function: bundles of a block and a group of items take up what one owner's terms contribute."""

    def contributions(tf: np.ndarray, n: np.ndarray, w: np.ndarray) -> np.ndarray:
        m = 100 - B1 + (B2 * n * n_docs) // n_terms
        return w * ((UNIT * tf) // (K1 * tf + 20 * m))

    def stage(left: pa.Table, right: pa.Table) -> pa.Table:
        bundle = {c: left.column(c)[0].as_py() for c in ("block", "part")}
        bar, rest = (_flat(left.column(c))[0] for c in ("bars", "rests"))
        item, ord_, score = (_flat(left.column(c))[0] for c in ("item", "ord", "score"))
        posted = [_flat(right.column(c)) for c in ("ord", "tf", "n")]
        width = 1 + max(int(ord_.max(initial=-1)), int(posted[0][0].max(initial=-1)))
        dense = np.zeros((len(bar), width), np.int64)
        dense[item, ord_] = score
        if right.num_rows:
            (at, sizes), (tf, _), (n, _) = posted
            add = contributions(tf, n, np.repeat(right.column("w").to_numpy(), sizes))
            users, counts = _flat(right.column("users"))
            u, p = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(sizes)]
            for i in range(right.num_rows):
                for user in users[u[i] : u[i + 1]].tolist():
                    dense[user, at[p[i] : p[i + 1]]] += add[p[i] : p[i + 1]]
        best = [_best(row, top) for row in dense]
        lowest = np.array([row[b[-1]] if len(b) == top else 0 for row, b in zip(dense, best, strict=True)], np.int64)
        item, ord_ = np.nonzero((dense > 0) & (dense + rest[:, None] >= np.maximum(bar, lowest)[:, None]))
        who, where = np.repeat(np.arange(len(best)), [len(b) for b in best]), np.concatenate([*best, np.zeros(0, int)])
        lists = {"item": (item, pa.int32()), "ord": (ord_, pa.int32()), "score": (dense[item, ord_], pa.int64())}
        lists |= {"best_item": (who, pa.int32()), "best_ord": (where, pa.int32()), "best_score": (dense[who, where], pa.int64())}
        return pa.table({**{k: pa.array([v], pa.int64()) for k, v in bundle.items()}, **{k: pa.array([v], pa.list_(t)) for k, (v, t) in lists.items()}})

    return stage


LISTS = "item array<int>, ord array<int>, score array<bigint>, best_item array<int>, best_ord array<int>, best_score array<bigint>"


class Search:
    """One run of items over a table of documents."""

    def __init__(self, docs: DataFrame, items: DataFrame, top: int):
        self.stage, self.top = Stage(docs.sparkSession, "search"), top
        wanted = self.stage.write(item_terms(items), "wanted")
        # items in groups of ITEMS: place says where an item stands in its group
        named = wanted.select("item_id").distinct()
        number = F.row_number().over(Window.partitionBy("bucket").orderBy("item_id")) - 1
        buckets = max(1, -(-named.count() // (ITEMS // 2)))
        dealt = named.withColumn("bucket", F.pmod(F.xxhash64("item_id"), F.lit(buckets)))
        part = (F.col("bucket") * (1 << 20) + F.floor(number / ITEMS)).cast("long")
        self.items = self.stage.write(dealt.select("item_id", part.alias("part"), (number % ITEMS).cast("int").alias("place")), "items")
        self.wanted = self.stage.write(wanted.join(self.items, wanted["item_id"].eqNullSafe(self.items["item_id"])).select("part", "place", "term"), "placed")
        self.index(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def index(self, docs: DataFrame) -> None:
        words = self.wanted.select("term").distinct()
        few = words.count() <= VOCABULARY
        vocabulary = frozenset(r["term"].encode() for r in words.collect()) if few else None
        schema = "block long, term string, ids array<long>, ord array<int>, tf array<long>, n array<long>"
        rows = self.stage.write(docs.mapInArrow(_index(vocabulary), schema), "index")
        self.blocks = rows.filter("term is null").select("block", "ids", "n")
        # read anew, so that cogroup can tell its two sides apart
        posted = docs.sparkSession.read.schema(rows.schema).parquet(self.stage.paths["index"]).filter("term is not null").drop("ids")
        self.postings = posted if few else self.stage.write(posted.join(words, "term", "left_semi"), "postings")
        has = F.size(F.filter("n", lambda x: x > 0))
        total = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
        got = self.blocks.agg(F.sum(has).alias("docs"), F.sum(total).alias("terms")).first()
        self.n_docs, self.n_terms = got["docs"] or 0, max(1, got["terms"] or 0)

    def owned(self) -> DataFrame:
        """(term, part, users, w, owner, most): the items of a group that use a term, its weight, its owner and the most that it can add."""
        n = self.n_docs
        share = F.aggregate(F.zip_with("n", "tf", lambda a, b: a / b), F.lit(float("inf")), lambda a, x: F.least(a, x))
        each = self.postings.select("term", F.size("ord").alias("df"), F.array_max("tf").alias("tf"), share.alias("share"))
        of = each.groupBy("term").agg(F.sum("df").alias("df"), F.max("tf").alias("tf"), F.min("share").alias("share"))
        w = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2.0 * F.col("df") + 1))).cast("long")
        owner = sum((F.when(F.col("df") > share * n, 1).otherwise(0) for share in OWNERS), F.lit(0))
        # a little more than any document's: 20 m is at least 980 + 1000 n N / L
        most = w * (F.floor(UNIT / (K1 + 980.0 / F.col("tf") + 1000.0 * F.col("share") * n / self.n_terms)) + 1)
        weighed = self.stage.write(of.select("term", w.alias("w"), owner.alias("owner"), most.alias("most")), "weighed")
        users = self.wanted.groupBy("term", "part").agg(F.collect_list("place").alias("users"))
        return self.stage.write(users.join(weighed, "term"), "owned")

    def limits(self, owned: DataFrame, owner: int, bundles: DataFrame | None) -> DataFrame:
        """By group of items: for each item its bar, and what the owners after this one can add."""
        later = owned.filter(F.col("owner") > owner).select("part", F.explode("users").alias("place"), "most")
        rest = later.groupBy("part", "place").agg(F.sum("most").alias("rest"))
        out = self.items.join(rest, ["part", "place"], "left")
        if bundles is None:
            out = out.withColumn("bar", F.lit(0).cast("long"))
        else:
            best = bundles.select("part", F.explode(F.arrays_zip("best_item", "best_score")).alias("x")).select("part", F.col("x.best_item").alias("place"), F.col("x.best_score").alias("score"))
            nth = F.row_number().over(Window.partitionBy("part", "place").orderBy(F.desc("score")))
            bars = best.withColumn("nth", nth).filter(F.col("nth") <= self.top).groupBy("part", "place").agg(F.when(F.count("*") == self.top, F.min("score")).alias("bar"))
            out = out.join(bars, ["part", "place"], "left")
        each = F.sort_array(F.collect_list(F.struct("place", F.coalesce("bar", F.lit(0)).alias("bar"), F.coalesce("rest", F.lit(0)).alias("rest"))))
        lists = out.groupBy("part").agg(each.alias("x"))
        return self.stage.write(lists.select("part", F.col("x.bar").alias("bars"), F.col("x.rest").alias("rests")), f"limits-{owner}")

    def run(self) -> DataFrame:
        owned, bundles = self.owned(), None
        step = _stage(self.n_docs, self.n_terms, self.top)
        sparse = [F.array().cast("array<int>").alias("item"), F.array().cast("array<int>").alias("ord"), F.array().cast("array<bigint>").alias("score")]
        parts = short(self.stage.write(self.items.select("part").distinct(), "parts"))
        # every group of items, bounded by the query set, meets every block of documents
        start = self.blocks.select("block", F.lit(1).alias("one")).join(parts.withColumn("one", F.lit(1)), "one").select("block", "part", *sparse)
        for owner in range(len(OWNERS) + 1):
            limits = short(self.limits(owned, owner, bundles))
            left = (start if bundles is None else bundles.select("block", "part", "item", "ord", "score")).join(limits, "part")
            used = short(self.stage.write(owned.filter(F.col("owner") == owner).select("term", "part", "users", "w"), f"used-{owner}"))
            right = self.postings.join(used, "term").select("block", "part", "users", "w", "ord", "tf", "n")
            added = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(step, f"block long, part long, {LISTS}")
            before, bundles = bundles, self.stage.write(added, f"bundles-{owner}")
            if before is not None:
                self.stage.drop(f"bundles-{owner - 1}")
        found = bundles.select("block", "part", F.explode(F.arrays_zip("best_item", "best_ord", "best_score")).alias("x"))
        found = found.select("block", "part", F.col("x.best_item").alias("place"), F.col("x.best_ord").alias("ord"), F.col("x.best_score").alias("score"))
        ids = self.blocks.select("block", F.posexplode("ids").alias("ord", "doc_id"))
        named = found.join(ids, ["block", "ord"]).join(self.items, ["part", "place"])
        rank = F.row_number().over(Window.partitionBy("part", "place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        return named.withColumn("rank", rank).filter(F.col("rank") <= self.top).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's best documents of (doc_id, text)."""
    return Search(docs, items, top).run()
