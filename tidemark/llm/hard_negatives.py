"""Hard-negative mining by exact inner product over STR-packed R-trees.

Vectors are scaled to whole numbers and dealt by ranges of label and first coordinate into parts of equal size (the
outer level of sort-tile-recursive packing; ids part equal vectors). A part's task packs its vectors into a tree: they
are cut into tiles coordinate by coordinate until a tile is a leaf, and some leaves make a node, with the least and
largest value of each coordinate for box. For an anchor, the sums over coordinates of the least and largest product
with a box bound its inner products there. The best node comes first out of a queue; a box whose bounds miss the
anchor's score windows, or whose upper bound is strictly below the k-th score found, is never opened; leaves are scored
some at a time.

Anchors are shipped to the parts they can find something in, after the part's vectors, and read as a stream, so a task
holds one part at any number of anchors. Positives come from the parts with the anchor's label. Negatives are searched
in a few parts first: the k-th score there is a bound for the search of all others, so these return few rows.

Edge cases: rows with a null id, label or vector, or with a null, not finite or huge component (2^20 and up) take no
part; of rows that repeat an id the least stays; only vectors of equal length are scored against each other; a positive
with a negative score has an empty window; ties go to the smaller id; further columns do no harm; an empty table gives
an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import over
from tidemark.llm._common import keyed, lean, small_or_not, stored

HUGE = float(1 << 20)
LEAF, FANOUT, AT_ONCE = 128, 8, 8  # vectors of a leaf, children of a node, leaves scored at once
LOWEST = -(1 << 62)


class Tree:
    """A packed R-tree of one part's vectors of one length."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = self._packed(labels, vectors)
        self.ids, self.labels, self.whole = ids[order], labels[order], vectors[order].astype(np.int64)
        self.vectors = self.whole.astype(np.float64)
        self.peak = float(np.abs(self.vectors).max(initial=0))
        start = np.arange(0, len(order), LEAF)
        low, high = (f.reduceat(self.vectors, start, axis=0) for f in (np.minimum, np.maximum))
        kinds = [np.minimum.reduceat(self.labels, start), np.maximum.reduceat(self.labels, start)]
        self.start, self.end = start, np.append(start[1:], len(order))
        self.children: list[tuple[int, int] | None] = [None] * len(start)
        first, n = 0, len(start)
        boxes, sides = [(low, high)], [kinds]
        while n > 1:
            cut = np.arange(0, n, FANOUT)
            self.children += [(first + a, first + min(n, a + FANOUT)) for a in cut.tolist()]
            low, high = np.minimum.reduceat(low, cut, axis=0), np.maximum.reduceat(high, cut, axis=0)
            kinds = [np.minimum.reduceat(kinds[0], cut), np.maximum.reduceat(kinds[1], cut)]
            boxes.append((low, high))
            sides.append(kinds)
            first, n = first + n, len(cut)
        self.low, self.high = (np.concatenate(x) for x in zip(*boxes, strict=True))
        self.least, self.most = (np.concatenate(x) for x in zip(*sides, strict=True))

    @staticmethod
    def _packed(labels: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Order of the vectors: by label, then tiles, coordinates of the widest spread first."""
        n, size = vectors.shape
        axes = np.argsort(-vectors.std(0), kind="stable")[: max(1, int(np.ceil(np.log2(max(2, n / LEAF)))))] if size else np.zeros(0, int)
        order = np.argsort(labels, kind="stable")

        def tile(part: np.ndarray, k: int) -> np.ndarray:
            if len(part) <= LEAF or k == len(axes):
                return part
            slabs = max(2, int(np.ceil((len(part) / LEAF) ** (1 / (len(axes) - k)))))
            part = part[np.argsort(vectors[part, axes[k]], kind="stable")]
            width = -(-len(part) // slabs // LEAF) * LEAF or LEAF  # whole leaves, but for the last
            return np.concatenate([tile(part[a : a + width], k + 1) for a in range(0, len(part), width)])

        cut = np.flatnonzero(np.diff(labels[order])) + 1
        return np.concatenate([tile(x, 0) for x in np.split(order, cut)]) if n else order

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, largest) inner product of each anchor with any vector in each box."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T

    def search(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, usable: np.ndarray, windows: np.ndarray, k: int, free: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the k best vectors in each window (least, most, bound known so far).

        low, high: the anchor's bounds for each box. usable: which boxes may hold vectors of use; free: which vectors.
        """
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        need, most = np.maximum(windows[:, 0], windows[:, 2]), windows[:, 1]  # a score of use is at least `need`
        wide = float(np.abs(anchor).sum()) * self.peak >= 2**53  # beyond what a double holds exactly: no bounds, whole numbers
        if wide:
            low, high = np.full(len(low), -np.inf), np.full(len(high), np.inf)
        opened = lambda n: usable[n] and bool(((high[n] >= need) & (low[n] <= most) & (need <= most)).any())
        root = len(self.children) - 1
        queue = [(-high[root], root)] if opened(root) else []
        while queue:
            leaves: list[int] = []
            while queue and len(leaves) < AT_ONCE:
                n = heapq.heappop(queue)[1]
                if not opened(n):
                    continue
                if self.children[n] is None:
                    leaves.append(n)
                else:
                    for child in range(*self.children[n]):
                        if opened(child):
                            heapq.heappush(queue, (-high[child], child))
            if not leaves:
                break
            at = np.concatenate([np.arange(self.start[n], self.end[n]) for n in leaves])
            if free is not None:
                at = at[free[at]]
            score = self.whole[at] @ anchor.astype(np.int64) if wide else (self.vectors[at] @ anchor).astype(np.int64)
            for w in range(len(windows)):
                hit = np.flatnonzero((score >= need[w]) & (score <= most[w]))
                if not len(hit):
                    continue
                ids, scores = np.concatenate([held[w][0], self.ids[at[hit]]]), np.concatenate([held[w][1], score[hit]])
                best = np.lexsort((ids, -scores))[:k]
                held[w] = ids[best], scores[best]
                if len(best) == k:
                    need[w] = max(need[w], scores[best[-1]])
        return held


def _trees(rows: pa.Table) -> dict[int, Tree]:
    """A tree for each length of vectors of a part."""
    column = rows.column("v").combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    flat, first = column.flatten().to_numpy(), column.offsets.to_numpy()[:-1] - column.offsets.to_numpy()[0]
    ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
    out = {}
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        out[n] = Tree(ids[at], labels[at], flat[first[at][:, None] + np.arange(n)].reshape(len(at), n))
    return out


def _searched(parts: DataFrame, anchors: DataFrame, n: int, k: int, negatives: bool) -> DataFrame:
    """(anchor_id, positive_id, positive_score, found_id, score): what each part holds of the k best in each window of an anchor.

    parts: (part, vec_id, label, v), parts numbered below n. anchors: (part, vec_id, label, v, windows), windows of (positive_id,
    positive_score, least, most, bound).
    """
    none = "array<struct<positive_id:bigint,positive_score:bigint,least:bigint,most:bigint,bound:bigint>>"
    data = parts.select("part", F.lit(0).alias("kind"), "vec_id", "label", "v", F.lit(None).cast(none).alias("windows"))
    asked = anchors.select("part", F.lit(1).alias("kind"), "vec_id", "label", "v", F.col("windows").cast(none).alias("windows"))
    dealt = data.unionByName(asked).repartitionById(n, F.col("part")).sortWithinPartitions("part", "kind")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, trees = None, [], {}
        names = ["anchor_id", "positive_id", "positive_score", "found_id", "score"]
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("part", "kind")], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(batch)] if len(batch) else [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                own, kind = key[a].tolist()
                if own != part:
                    part, held, trees = own, [], {}
                if kind == 0:
                    held.append(batch.slice(a, b - a))
                    continue
                if held:
                    trees, held = _trees(pa.Table.from_batches(held)), []
                found = [x for i in range(a, b, 64) for x in _answers(trees, batch.slice(i, min(b, i + 64) - i), k, negatives)]
                if found:
                    columns = [np.concatenate([np.full(len(x[3]), x[c]) if c < 3 else x[c] for x in found]).astype(np.int64) for c in range(5)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return dealt.mapInArrow(run, "anchor_id long, positive_id long, positive_score long, found_id long, score long")


def _answers(trees: dict[int, Tree], batch: pa.RecordBatch, k: int, negatives: bool) -> Iterator[tuple]:
    """(anchor, positive, its score, ids found, their scores) for a batch of anchors."""
    rows = [(r["vec_id"], r["label"], r["v"], r["windows"]) for r in batch.to_pylist()]
    for size, tree in trees.items():
        own = [r for r in rows if len(r[2]) == size]
        if not own or not len(tree.ids):
            continue
        vectors = np.array([r[2] for r in own], np.float64).reshape(len(own), size)
        low, high = tree.bounds(vectors)
        for i, (anchor, label, _, windows) in enumerate(own):
            spans = np.array([(w["least"], w["most"], w["bound"]) for w in windows], np.int64).reshape(-1, 3)
            if negatives:
                usable, free = (tree.least != label) | (tree.most != label), tree.labels != label
            else:
                usable, free = (tree.least <= label) & (label <= tree.most), (tree.labels == label) & (tree.ids != anchor)
            for w, (ids, scores) in zip(windows, tree.search(vectors[i], low[i], high[i], usable, spans, k, free), strict=True):
                if len(ids):
                    yield anchor, w["positive_id"], w["positive_score"], ids, scores


def _window(least, most, bound=LOWEST, positive=0, score=0):
    lit = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("long")
    return F.struct(lit(positive).alias("positive_id"), lit(score).alias("positive_score"), lit(least).alias("least"), lit(most).alias("most"), lit(bound).alias("bound"))


def hard_negatives(vectors: DataFrame, anchors: str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256, part_rows: int = 65_536, first: int = 16) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vectors: (vec_id long, label, embedding). anchors: which rows are anchors. A negative's score lies between `least`
    and `most` hundredths of the positive's. part_rows: vectors of a part at most, about; at least 12 parts are made.
    first: of so many parts one is searched first.
    """
    spark = vectors.sparkSession
    fits = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < HUGE))  # NaN is above all numbers
    rows = keyed(vectors, "vec_id", "label", "embedding").where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(fits, F.lit(False)))
    rows = rows.select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("int")).alias("v"))
    count = rows.count()
    n = max(12, -(-count // part_rows))
    dealt = rows.repartitionByRange(n, "label", F.get("v", F.lit(0)), "vec_id")
    parts = stored(dealt.withColumn("part", F.spark_partition_id()), "parts")
    n = 1 + (parts.agg(F.max("part")).first()[0] or 0)
    asked = parts.where(anchors).select("vec_id", "label", "v")

    labels = parts.groupBy("label", "part").count().select("label", "part")
    own = asked.join(small_or_not(labels, 16 << 20), "label").select("part", "vec_id", "label", "v", F.array(_window(LOWEST, -LOWEST)).alias("windows"))
    found = _searched(parts, own, n, positives, False)
    rank = F.row_number().over(over("anchor_id", by=[F.desc("score"), "found_id"]))
    pairs = stored(found.withColumn("rank", rank).where(F.col("rank") <= positives).select("anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    pairs = pairs.where("positive_score >= 0")
    pairs = pairs.withColumn("least", F.expr(f"({least} * positive_score + 99) div 100")).withColumn("most", F.expr(f"{most} * positive_score div 100"))

    def negatives_in(which, known: DataFrame | None) -> DataFrame:
        told = pairs.join(known, ["anchor_id", "positive_id"], "left") if known is not None else pairs.withColumn("bound", F.lit(LOWEST))
        windows = told.groupBy("anchor_id").agg(F.collect_list(_window(F.col("least"), F.col("most"), F.coalesce("bound", F.lit(LOWEST)), F.col("positive_id"), F.col("positive_score"))).alias("windows"))  # at most `positives`
        some = parts.where(which("part"))
        each = asked.join(windows, F.col("vec_id") == F.col("anchor_id")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).where(which("part"))
        return _searched(some, each.select("part", "vec_id", "label", "v", "windows"), n, negatives, True)

    early = stored(negatives_in(lambda c: F.col(c) % first == 0, None), "early")
    kth = F.get(F.sort_array(F.collect_list("score"), False), F.lit(negatives - 1))  # a few parts' best
    known = early.groupBy("anchor_id", "positive_id").agg(kth.alias("bound"))
    late = negatives_in(lambda c: F.col(c) % first != 0, known)
    best = F.row_number().over(over("anchor_id", "positive_id", by=[F.desc("score"), "found_id"]))
    both = early.unionByName(late).withColumn("rank", best).where(F.col("rank") <= negatives)
    return both.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
