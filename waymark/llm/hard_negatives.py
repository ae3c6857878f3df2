"""Hard negatives by anchor-clustered shared lists.

Anchors are clustered by direction. For a cluster with centre c and largest angle t between c and a member, no member can score
more with a candidate x than |member| |x| cos(max(0, angle(c, x) - t)). Candidates are sorted once for a cluster by this angular
bound, and all members walk the same list until they are certified to be done: a member stops where the bound falls
below the worst score that it would still take. Positives are walked for first; they fix the scores between which an anchor
looks for negatives, and thus how far it walks the list of other labels.

The list of a cluster is cut into bands by a histogram of the bounds: FIRST candidates, then GROWTH times as many with each
band. Only clusters with unfinished members get the next band, so what is shuffled follows the length of the walks, not
clusters times rows. A band is dealt to parts of PART candidates and blocks of BLOCK members, each sorted
and walked by a task of bounded memory; the first of all parts are merged before the next band.

Of equal vectors with one label only the smallest ids, as many as are asked for and one more, can be among the first
of any anchor, so a vector that holds a third of all rows is a few candidates. Where vectors have no direction in common the bounds
are loose and lists are walked to their end: results stay exact, the work is then anchors times rows.

Centres are fitted on FIT_ROWS anchors and bins on FIT_ROWS candidates; every anchor and candidate is used. On the driver: at most CLUSTERS centres, radii and
histograms.

Defined results: rows with a null id, label or vector, or a component that is null, NaN or infinite, take no part; a shorter vector
counts as padded with zeros; repeated rows are one row; another row is one with another id; rows that share an id but not
the vector or label are candidates, and anchors, of their own; ties go to the smaller id; an anchor without rows of its
label has no positives and no result; an empty table gives an empty result; other columns are ignored. Scores have to fit a long: a scaled
component beyond 2^27 raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.staging import Stage

CLUSTERS, CLUSTER_ANCHORS, FIT_ROWS, FIT_ROUNDS = 256, 256, 16_384, 10
BLOCK, FIRST, GROWTH, PART, CHUNK, BINS = 512, 8192, 8, 32_768, 1024, 256
LARGEST = 1 << 27
#: What rounding may take from an angle, and from a score of one unit of both norms.
SLACK = 1e-6
LOW, HIGH = int(np.iinfo(np.int64).min), int(np.iinfo(np.int64).max)


def takes_part(id_: Column, label: Column, vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return id_.isNotNull() & label.isNotNull() & vector.isNotNull() & finite


def _matrix(column: pa.Array) -> np.ndarray:
    """Packed vectors as rows, padded with zeros."""
    cells = [np.frombuffer(x, np.int32) for x in column.to_pylist()]
    out = np.zeros((len(cells), max(map(len, cells), default=0)))
    for i, x in enumerate(cells):
        out[i, : len(x)] = x
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows, exact: in doubles where they stay below 2^53, else in longs."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if not d or not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if d * np.abs(a).max() * np.abs(b).max() < 1 << 53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """embedding becomes q, its scaled components without trailing zeros as 32-bit integers, and norm."""
    for b in it:
        cells, norms = [], []
        for x in b.column("embedding").to_numpy(zero_copy_only=False):
            q = np.floor(256 * np.asarray(x, np.float64))
            if len(q) and np.abs(q).max() > LARGEST:
                raise ValueError("a component is too large for scores in a long")
            q = q[: int(np.flatnonzero(q)[-1]) + 1 if q.any() else 0]
            cells.append(q.astype("<i4").tobytes())
            norms.append(float(np.sqrt(q @ q)))
        kept = [b.column(c) for c in ("id", "label", "is_anchor")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(cells, pa.binary()), pa.array(norms, pa.float64())], names=["id", "label", "is_anchor", "q", "norm"])


def _angles(rows: np.ndarray, norms: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angles between rows and unit centres; that of a zero vector is 0."""
    d = min(rows.shape[1], centres.shape[1])
    dots = rows[:, :d] @ centres[:, :d].T
    return np.where(norms[:, None] > 0, np.arccos(np.clip(dots / np.where(norms > 0, norms, 1)[:, None], -1, 1)), 0.0)


def fit_centres(rows: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from evenly spaced rows."""
    unit = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    centres = unit[np.linspace(0, len(unit) - 1, k).astype(int)]
    for _ in range(FIT_ROUNDS):
        near = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-12), centres)
    return centres


def _first(k: int, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the first k of each group, in the order of groups, by falling score and rising id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    begins = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    place = np.arange(len(g)) - np.repeat(begins, np.diff(np.r_[begins, len(g)]))
    return order[place < k]


class Lists:
    """Clusters, their radii, and the bands of their lists."""

    def __init__(self, centres: np.ndarray, radii: np.ndarray, sizes: np.ndarray, largest: float):
        self.centres, self.radii, self.largest = centres, radii, max(largest, 1.0)
        self.blocks, self.n = np.maximum(1, -(-sizes // BLOCK)), BINS

    def bounds(self, rows: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """The most that a member of unit norm of each cluster can score with each row."""
        angle = np.maximum(0, _angles(rows, norms, self.centres) - self.radii - SLACK)
        return norms[:, None] * (np.cos(np.minimum(angle, np.pi)) + SLACK)

    def cut(self, bounds: np.ndarray) -> None:
        """Cuts of each cluster's bounds into bins that hold about as many candidates each, by those of a sample."""
        share = np.arange(1, self.n) / self.n
        self.cuts = np.quantile(bounds, share, axis=0).T if len(bounds) else np.zeros((len(self.centres), self.n - 1))

    def bins(self, bounds: np.ndarray) -> np.ndarray:
        """0 for the highest bounds."""
        return np.stack([self.n - 1 - np.searchsorted(c, b, "right") for c, b in zip(self.cuts, bounds.T, strict=True)], axis=1)

    def edge(self, bins: np.ndarray) -> np.ndarray:
        """For a bin of each cluster: no bound from this bin on is larger."""
        upper = self.cuts[np.arange(len(bins)), np.clip(self.n - 1 - bins, 0, self.n - 2)]
        return np.where(bins == 0, self.largest * (1 + 2 * SLACK), upper) + SLACK

    def lay_out(self, counts: np.ndarray) -> None:
        """Bands as first bins of each cluster (rows: bands); counts by cluster and bin."""
        upto, bands, size = np.cumsum(counts, axis=1), [np.zeros(len(counts), np.int64)], FIRST
        while (bands[-1] < self.n).any():
            start = np.where(bands[-1] > 0, np.take_along_axis(upto, np.maximum(bands[-1] - 1, 0)[:, None], axis=1)[:, 0], 0)
            bands.append(np.minimum(self.n, np.maximum(bands[-1] + 1, (upto < (start + size)[:, None]).sum(axis=1) + 1)))
            size *= GROWTH
        self.bands = np.array(bands)
        held = [np.where(b > 0, np.take_along_axis(upto, np.maximum(b - 1, 0)[:, None], axis=1)[:, 0], 0) for b in self.bands]
        self.parts = [max(1, int(-(-np.diff(np.array(held), axis=0)[i].max() // PART))) for i in range(len(bands) - 1)]


def _walk(k: int, same: bool):
    """Cogroup function: a block of members walks a part of its cluster's list and returns hits (aid, j, score, id)."""

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"aid": [], "j": [], "score": [], "id": []}
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            order = np.argsort(-right.column("bound").to_numpy(), kind="stable")
            bound, cid, clabel = (right.column(c).to_numpy()[order] for c in ("bound", "id", "label"))
            packed = right.column("q").combine_chunks().take(pa.array(order))
            aid, own, label, norm = (left.column(c).to_numpy() for c in ("aid", "id", "label", "norm"))
            member, caps = _matrix(left.column("q").combine_chunks()), left.column("caps").to_pylist()
            j_of = np.array([len(c) for c in caps])
            # one row for each member and each of its caps
            who, cap, bar = np.repeat(np.arange(len(aid)), j_of), *(np.array([x for c in left.column(n).to_pylist() for x in c], np.int64) for n in ("caps", "bars"))
            j = np.concatenate([np.arange(n) for n in j_of])
            got_t, got_s, got_i = (np.zeros(0, np.int64) for _ in range(3))
            first = np.r_[0, np.cumsum(j_of)[:-1]]
            for lo in range(0, len(order), CHUNK):
                least = np.minimum.reduceat(bar, first)
                live = np.flatnonzero(bound[lo] * norm + SLACK >= least)
                if not len(live):
                    break
                hi = min(lo + CHUNK, len(order))
                scores = _product(member[live], _matrix(packed.slice(lo, hi - lo)))
                fits = (label[live][:, None] == clabel[lo:hi]) == same
                m, c = np.nonzero(fits & (own[live][:, None] != cid[lo:hi]) & (scores >= least[live][:, None]))
                s, c, m = scores[m, c], c + lo, live[m]
                for n in range(j_of.max(initial=0)):  # caps of a member: at most as many as positives
                    has = n < j_of[m]
                    t, sn, cn = first[m[has]] + n, s[has], c[has]
                    ok = (sn <= cap[t]) & (sn >= bar[t])
                    got_t, got_s, got_i = np.r_[got_t, t[ok]], np.r_[got_s, sn[ok]], np.r_[got_i, cid[cn[ok]]]
                keep = _first(k, got_t, got_s, got_i)
                got_t, got_s, got_i = got_t[keep], got_s[keep], got_i[keep]
                ends = np.flatnonzero(np.r_[got_t[1:] != got_t[:-1], True]) if len(got_t) else np.zeros(0, int)
                full = ends[np.diff(np.r_[-1, ends]) == k]
                bar[got_t[full]] = np.maximum(bar[got_t[full]], got_s[full])
            out = {"aid": aid[who[got_t]], "j": j[got_t], "score": got_s, "id": got_i}
        return pa.table({n: pa.array(v, pa.int32() if n == "j" else pa.int64()) for n, v in out.items()})

    return walk


class Mining:
    """One run over a table (id, label, embedding, is_anchor)."""

    def __init__(self, rows: DataFrame, positives: int, negatives: int):
        self.stage, self.k = Stage(rows.sparkSession, "negatives"), (positives, negatives)
        used = rows.filter(takes_part(F.col("id"), F.col("label"), F.col("embedding")))
        typed = used.select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"), "is_anchor")
        packed = typed.mapInArrow(_pack, "id long, label long, is_anchor boolean, q binary, norm double")
        distinct = packed.groupBy("label", "q", "id").agg(F.max("is_anchor").alias("is_anchor"), F.first("norm").alias("norm"))
        self.rows = self.stage.write(distinct, "rows")
        among = F.row_number().over(Window.partitionBy("label", "q").orderBy("id"))
        few = self.rows.withColumn("n", among).filter(F.col("n") <= max(self.k) + 1)
        self.candidates = self.stage.write(few.select("id", "label", "q", "norm"), "candidates")

    def cluster(self) -> DataFrame:
        """Anchors with cluster and block; fills self.lists."""
        anchors = self.stage.write(self.rows.filter("is_anchor").select("id", "label", "q", "norm", F.monotonically_increasing_id().alias("aid")), "anchors")
        n = anchors.count()
        k = max(1, min(CLUSTERS, n // CLUSTER_ANCHORS))
        fit = _matrix(pa.array([r["q"] for r in anchors.orderBy(F.xxhash64("id", "q")).select("q").limit(FIT_ROWS).collect()], pa.binary()))
        centres = fit_centres(fit, min(k, len(fit))) if len(fit) else np.zeros((1, 1))

        def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                angles = _angles(_matrix(b.column("q")), b.column("norm").to_numpy(), centres)
                near = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(angles.min(axis=1))], names=[*b.schema.names, "cluster", "angle"])

        placed = self.stage.write(anchors.mapInArrow(assign, "id long, label long, q binary, norm double, aid long, cluster int, angle double"), "placed")
        radii, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
        for r in placed.groupBy("cluster").agg(F.max("angle").alias("a"), F.count("*").alias("n")).collect():
            radii[r["cluster"]], sizes[r["cluster"]] = r["a"], r["n"]
        largest = self.candidates.agg(F.max("norm")).first()[0] or 0.0
        self.lists = lists = Lists(centres, radii, sizes, largest)
        some = self.candidates.orderBy(F.xxhash64("id", "q")).select("q", "norm").limit(FIT_ROWS).collect()
        lists.cut(lists.bounds(_matrix(pa.array([r["q"] for r in some], pa.binary())), np.array([r["norm"] for r in some])))

        def histogram(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((len(centres), lists.n), np.int64)
            for b in it:
                at = lists.bins(lists.bounds(_matrix(b.column("q")), b.column("norm").to_numpy()))
                for c in range(len(centres)):
                    counts[c] += np.bincount(at[:, c], minlength=lists.n)
            c, n = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (c, n, counts[c, n])], names=["c", "b", "n"])

        counts = np.zeros((len(centres), lists.n), np.int64)
        for r in self.candidates.mapInArrow(histogram, "c long, b long, n long").groupBy("c", "b").agg(F.sum("n").alias("n")).collect():
            counts[r["c"], r["b"]] = r["n"]
        lists.lay_out(counts)
        blocks = F.get(F.lit(lists.blocks.tolist()), F.col("cluster"))
        return placed.withColumn("block", F.pmod(F.xxhash64("aid"), blocks).cast("int")).drop("angle")

    def band(self, r: int, clusters: list[int]) -> DataFrame:
        """Band r of the clusters' lists, once for each block: (cluster, block, part, bound, id, label, q)."""
        lists, parts = self.lists, self.lists.parts[r]

        def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                bounds = lists.bounds(_matrix(b.column("q")), b.column("norm").to_numpy())
                bins = lists.bins(bounds)
                for c in clusters:
                    here = np.flatnonzero((bins[:, c] >= lists.bands[r][c]) & (bins[:, c] < lists.bands[r + 1][c]))
                    for block in range(lists.blocks[c] if len(here) else 0):
                        sent, n = b.take(pa.array(here)), len(here)
                        part = sent.column("id").to_numpy() % parts
                        cells = [pa.array(np.full(n, x, np.int32)) for x in (c, block)]
                        yield pa.RecordBatch.from_arrays(
                            [*cells, pa.array(part.astype(np.int32)), pa.array(bounds[here, c]), *(sent.column(x) for x in ("id", "label", "q"))],
                            names=["cluster", "block", "part", "bound", "id", "label", "q"],
                        )

        return self.candidates.mapInArrow(emit, "cluster int, block int, part int, bound double, id long, label long, q binary")

    def walk(self, anchors: DataFrame, targets: DataFrame, same: bool, k: int, tag: str) -> DataFrame:
        """For each target (aid, j, cap, low) the first k candidates with low <= score <= cap, as (aid, j, score, id)."""
        hits, lists = None, self.lists
        for r in range(len(lists.bands) - 1):
            bar = targets.withColumn("bar", F.col("low"))
            if hits is not None:
                worst = hits.groupBy("aid", "j").agg(F.when(F.count("*") == k, F.min("score")).alias("worst"))
                bar = targets.join(worst, ["aid", "j"], "left").withColumn("bar", F.greatest("low", F.coalesce("worst", F.lit(LOW))))
            each = F.sort_array(F.collect_list(F.struct("j", "cap", "bar")))
            state = bar.groupBy("aid").agg(each.alias("t"), F.min("bar").alias("least")).select("aid", "least", F.col("t.cap").alias("caps"), F.col("t.bar").alias("bars"))
            top = F.get(F.lit(lists.edge(lists.bands[r]).tolist()), F.col("cluster"))
            live = anchors.join(state, "aid").filter(top * F.col("norm") + SLACK >= F.col("least").cast("double"))
            live = self.stage.write(live, f"{tag}-live-{r}")
            clusters = sorted(x["cluster"] for x in live.select("cluster").distinct().collect())
            if not clusters:
                break
            members = live.withColumn("part", F.explode(F.lit(list(range(lists.parts[r])))))
            keys = ["cluster", "block", "part"]
            found = members.groupBy(*keys).cogroup(self.band(r, clusters).groupBy(*keys)).applyInArrow(_walk(k, same), "aid long, j int, score long, id long")
            every = found if hits is None else found.union(hits)
            order = Window.partitionBy("aid", "j").orderBy(F.desc("score"), "id")
            first = every.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).drop("n")
            hits = self.stage.write(first, f"{tag}-hits-{r}")
            self.stage.drop(f"{tag}-live-{r}", *([f"{tag}-hits-{r - 1}"] if r else []))
        return hits

    def run(self, low: int, high: int) -> DataFrame:
        anchors = self.stage.write(self.cluster(), "members")
        once = anchors.select("aid", F.lit(0).alias("j"), F.lit(HIGH).alias("cap"), F.lit(LOW).alias("low"))
        empty = anchors.sparkSession.createDataFrame([], "aid long, j int, score long, id long")
        positives = self.walk(anchors, once, True, self.k[0], "positives") or empty
        # positives of one score share their negatives
        caps = positives.select("aid", "score").distinct().filter("score >= 0")
        j = F.row_number().over(Window.partitionBy("aid").orderBy("score")) - 1
        bounds = {"cap": F.expr(f"{high} * score div 100"), "low": F.expr(f"({low} * score + 99) div 100")}
        targets = self.stage.write(caps.select("aid", "score", j.alias("j"), *(v.alias(n) for n, v in bounds.items())), "targets")
        negatives = self.walk(anchors, targets.drop("score"), False, self.k[1], "others") or empty
        place = F.row_number().over(Window.partitionBy("aid", "j").orderBy(F.desc("score"), "id"))
        ranked = negatives.select("aid", "j", place.alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        pairs = positives.select("aid", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        at = targets.select("aid", F.col("score").alias("positive_score"), "j")
        named = anchors.select("aid", F.col("id").alias("anchor_id"))
        out = pairs.join(at, ["aid", "positive_score"]).join(ranked, ["aid", "j"]).join(named, "aid")
        return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """For each row of (id, label, embedding, is_anchor) with is_anchor and each of its first positives of the same label, the
    first negatives of other labels whose score is between low and high per cent of the positive's (0 <= low, high)."""
    return Mining(rows, positives, negatives).run(low, high)
