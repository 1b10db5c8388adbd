"""Ranked lexical search of many items at once, by sums that items share.

Each document's text is read once: what it holds of the items' terms is written as one narrow row a document. From these
rows come the counts (documents with terms, terms in all, documents a term). Term sets that several items share are
mined: pairs of terms, then of such pairs, that stand together in most items become nodes of a graph whose leaves are
terms, so an item is a sum of few nodes. Documents are then scored in blocks: a term's points fill one row of a matrix
(nodes by documents), each node adds up its two parts once, level by level, and items add up the nodes left to them.
Nodes without a posting in the block are left out. Each task keeps the best documents of each item, and these meet by
item. Items are dealt into shards by their number of terms, so what a task holds of them is bounded at any number; the
document rows of a shard are written and read once.

Edge cases: a null or empty text, or one without a term, counts neither as a document nor in the lengths; an item
without terms, or whose terms no document has, gives no rows; ties go to the smaller doc_id; rows with a null id go, of
rows that repeat an id the least stays; longer texts are worked on in pieces that end between terms; further columns do
no harm; empty tables give an empty result. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import over
from tidemark.llm._common import _LOWER, _hashed, keyed, lean, stored, text_slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SOLID = np.ones(256, bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _SOLID[_a : _b + 1] = False
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PIECE = 1 << 20
CELLS = 1 << 22  # of a block's matrix
PAIRED = 32  # nodes of an item that are paired with each other


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, start, end) of each term; texts' bounds part terms."""
    low, n = _LOWER[data], len(data)
    solid = _SOLID[low]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before, after = np.append(False, solid[:-1]), np.append(solid[1:], False)
    return low, np.flatnonzero(solid & (~before | cut[:n])), np.flatnonzero(solid & (~after | cut[1:])) + 1


class Vocabulary:
    """Terms by their hashes, behind a table of the hashes' first bits that rules most words out."""

    BITS = 20

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        keys = _hashed(data, np.concatenate([[0], ends])[:-1].astype(np.int64), ends) if raw else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.number = keys[order], order.astype(np.int32)
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two terms have one hash")
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[(keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the hashes that are terms, numbers of these)."""
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], self.number[:0]
        found = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        hit = self.keys[found] == hashes[at]
        return at[hit], self.number[found[hit]]


def _cut(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces that end between terms."""
    at = 0
    while at < len(data):
        to = min(len(data), at + PIECE)
        while to < len(data) and not len(gap := np.flatnonzero(~_SOLID[data[to : to + PIECE]])):
            to = min(len(data), to + PIECE)
        to = to if to == len(data) else to + int(gap[0])
        yield data[at:to]
        at = to


def postings(documents: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, terms, tf): each document's number of terms, and which of the given ones it holds how often."""
    shared = documents.sparkSession.sparkContext.broadcast(Vocabulary(terms))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        many = np.int64(max(1, len(words.keys)))
        for batch in batches:
            for at, data, offsets in text_slices(batch.column("text"), PIECE):
                rows = len(offsets) - 1
                n, found = np.zeros(rows, np.int64), []
                for part in _cut(data) if rows == 1 and len(data) > 2 * PIECE else [data]:
                    bounds = np.array([0, len(part)]) if rows == 1 else offsets
                    low, start, end = _terms(part, bounds)
                    first = np.searchsorted(start, bounds)
                    n += np.diff(first)
                    place, number = words.numbers(_hashed(low, start, end))
                    found.append((np.searchsorted(first, place, "right") - 1) * many + number)
                own, tf = np.unique(np.concatenate(found), return_counts=True)
                bounds = np.searchsorted(own, np.arange(rows + 1) * many).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int32))) for x in (own % many, tf)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, rows), pa.array(n), *lists], ["doc_id", "n", "terms", "tf"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, tf array<int>")


def counts(rows: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """(documents with terms, all terms, documents of each given term), from postings."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(terms, np.int64)
        for batch in batches:
            held += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=terms)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], ["term", "df"])

    total = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    df = np.zeros(terms, np.int64)
    for r in rows.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a term of the shard
        df[r.term] = r.df
    return total.n, total.l, df


def shared_sums(items: list[list[int]], terms: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """(parts of each node beyond the terms, nodes of each item): pairs that most items share become nodes, round by round.

    An item's term stays in exactly one of its nodes, so its nodes add up to its terms. An item pairs nodes only in
    blocks of PAIRED, those of most items first.
    """
    nodes: list[tuple[int, int]] = []
    own = [set(x) for x in items]
    while True:
        often = Counter(x for one in own for x in one)
        pairs: Counter = Counter()
        for one in own:
            common = sorted((x for x in one if often[x] > 1), key=lambda x: (-often[x], x))
            for k in range(0, len(common), PAIRED):
                pairs.update(combinations(sorted(common[k : k + PAIRED]), 2))
        holders: dict[int, set[int]] = {}
        for i, one in enumerate(own):
            for x in one:
                holders.setdefault(x, set()).add(i)
        made = False
        for (a, b), _ in sorted(((p, c) for p, c in pairs.items() if c > 1), key=lambda x: (-x[1], x[0])):
            both = holders[a] & holders[b]
            if len(both) < 2:
                continue
            nodes.append((a, b))
            made = True
            for i in both:
                own[i] -= {a, b}
                own[i].add(terms + len(nodes) - 1)
            holders[a] -= both
            holders[b] -= both
        if not made:
            return nodes, [sorted(x) for x in own]


class Plan:
    """A shard of items as a graph of shared sums."""

    def __init__(self, items: list, terms: list[list[int]], weights: np.ndarray):
        self.items, self.weights, self.terms = items, weights, len(weights)
        nodes, left = shared_sums(terms, self.terms)
        self.parts = np.array(nodes, np.int64).reshape(-1, 2)
        depth = np.zeros(self.terms + len(nodes), np.int64)
        for k, (a, b) in enumerate(nodes):
            depth[self.terms + k] = 1 + max(depth[a], depth[b])
        self.levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max(initial=0)) + 1)]
        self.sizes = np.array([len(x) for x in left], np.int64)
        self.left = np.array([x for one in left for x in one], np.int64)
        self.block = int(np.clip(CELLS // max(1, len(depth), len(items)), 1, 1024))

    def scores(self, row: np.ndarray, term: np.ndarray, points: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(items that have points, their points by row) from postings (row, term, points)."""
        live = np.zeros(self.terms + len(self.parts), bool)
        live[term] = True
        for level in self.levels:
            live[level] = live[self.parts[level - self.terms]].any(1)
        place = np.where(live, np.cumsum(live), 0)
        total = np.zeros((int(place.max(initial=0)) + 1, rows), np.int64)  # the first row is that of all idle nodes
        total[place[term], row] = points
        for level in self.levels:
            on = level[live[level]]
            a, b = place[self.parts[on - self.terms]].T
            total[place[on]] = total[a] + total[b]
        on = live[self.left]
        item = np.repeat(np.arange(len(self.items)), self.sizes)[on]
        if not len(item):
            return item, total[:0]
        first = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        return item[first], np.add.reduceat(total[place[self.left[on]]], first, axis=0)


class Best:
    """The best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)  # the score a document needs
        self.item, self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = np.concatenate([self.item, item]), np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((np.unique(doc, return_inverse=True)[1], -score, item))
        item, score, doc = item[order], score[order], doc[order]
        count = np.arange(len(item))
        first = np.maximum.accumulate(np.where(np.append(True, item[1:] != item[:-1]), count, 0)) if len(item) else count
        rank = count - first
        full = rank == self.k - 1
        self.least[item[full]] = score[full]
        keep = rank < self.k
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]


def best_documents(rows: DataFrame, plan: Plan, total: int, length: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): at least the k best documents of each item, k a task."""
    shared = rows.sparkSession.sparkContext.broadcast(plan)
    kind, item_kind = rows.schema["doc_id"].dataType.simpleString(), plan.kind

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, doc_type = shared.value, None
        best = Best(len(plan.items), k)
        for whole in batches:
            doc_type = whole.schema.field("doc_id").type
            for a in range(0, len(whole), plan.block):
                batch = whole.slice(a, plan.block)
                size = np.diff(batch.column("terms").offsets.to_numpy())
                row = np.repeat(np.arange(len(batch)), size)
                if not len(row):
                    continue
                term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tf"))
                m = 10 + 90 * batch.column("n").to_numpy().astype(np.int64) * total // length
                points = plan.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
                item, score = plan.scores(row, term, points, len(batch))
                i, j = np.nonzero(score >= best.least[item][:, None])
                if len(i):
                    best.add(item[i], score[i, j], np.array(batch.column("doc_id").to_pylist(), object)[j])
        if len(best.item):
            ids = pa.array(plan.items).take(pa.array(best.item))
            yield pa.RecordBatch.from_arrays([ids, pa.array(best.doc.tolist(), doc_type), pa.array(best.score)], ["item_id", "doc_id", "score"])

    return rows.select("doc_id", "n", "terms", "tf").mapInArrow(run, f"item_id {item_kind}, doc_id {kind}, score long")


def search(documents: DataFrame, items: DataFrame, k: int = 10, shard_terms: int = 200_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest scores above 0 for each item.

    documents: (doc_id, text); items: (item_id, text). shard_terms: about how many terms, counted by item, a shard holds.
    """
    spark = documents.sparkSession
    docs = keyed(documents, "doc_id", "text")
    told = F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0)))
    asked = keyed(items, "item_id", "text").where("text is not null").select("item_id", told.alias("terms")).where(F.size("terms") > 0)
    shards = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // shard_terms)
    asked = stored(asked.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(max(1, shards)))), "items")
    item_kind, doc_kind = asked.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    found = None
    for shard in range(shards):
        own = sorted(asked.where(F.col("shard") == shard).select("item_id", "terms").collect())  # one shard's items
        if not own:
            continue
        terms = sorted({t for r in own for t in r.terms})
        number = {t: i for i, t in enumerate(terms)}
        rows = stored(postings(docs, terms), f"postings{shard}")
        total, length, df = counts(rows, len(terms))
        if not length:
            break
        weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        plan = Plan([r.item_id for r in own], [[number[t] for t in r.terms] for r in own], weights)
        plan.kind = item_kind
        some = best_documents(rows, plan, total, length, k)
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = spark.createDataFrame([], f"item_id {item_kind}, doc_id {doc_kind}, score long")
    rank = F.row_number().over(over("item_id", by=[F.desc("score"), "doc_id"]))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
