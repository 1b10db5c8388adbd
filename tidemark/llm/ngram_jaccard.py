"""N-gram Jaccard join: T-occurrence search over inverted lists, with DivideSkip.

Two documents of n and m shingles link when their sets share at least T = ceil(j (n + m) / (1 + j)). Documents with
equal sets are one class and one query. The search is split over the cluster by *shingle*: under one global order
(frequent shingles last, else by hash) a document need only enter the inverted lists of its first n - ceil(j n) + 1
shingles, and linked documents meet in one of them.

* Short lists are merged: Spark joins their entries, counts what each pair shares, and drops pairs whose count and
  list positions, or whose bitmaps (a bit or two a shingle), rule T out.
* Long lists are never expanded into pairs. Of those up to a block's length, documents that bitmaps show to be unlike
  all others of the list are taken out first. What hangs together by pairs or long lists is a group; a group (or a long
  list, where that ships less) is searched as a whole: a task holds a block of documents, merges the short lists of its
  own inverted index, keeps documents found T - L times, binary-probes the L long lists for the rest, and returns edges
  that span what it linked.
* What is larger than a block is dealt by set size into levels, of which only neighbours can link. Each document is
  first compared with a few pivots of its own and the neighbouring levels. Documents that pivots link to the group's
  largest component need no search among themselves: only the others are searched for, in all blocks of the levels
  near them. So a large group of near copies costs a few comparisons a document, not a search of all by all.

Edge cases: a null or blank text has the empty set (n_shingles 0) and links with nothing; fewer words than the width
are one shingle; rows with a null doc_id go, of rows that repeat a doc_id the least text stays.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import keyed, lean, packed, runs_by_key, shingle_hashes, small_or_not, stored, text_slices, word_hashes
from tidemark.llm._components import components, forest


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, data, offsets in text_slices(column):
        words, _, _, first = word_hashes(data, offsets)
        for i in range(len(offsets) - 1):
            yield np.unique(shingle_hashes(words[first[i] : first[i + 1]], width))


def least_overlap(n: int, m: int, percent: int) -> int:
    """What sets of n and m must share at least."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def known(sets: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Whether each shingle is among the (sorted) frequent ones."""
    if not len(frequent):
        return np.zeros(len(sets), bool)
    return frequent[np.minimum(np.searchsorted(frequent, sets), len(frequent) - 1)] == sets


def ordered(sets: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Rare shingles by hash, then the frequent ones by hash."""
    often = known(sets, frequent)
    return np.concatenate([sets[~often], sets[often]])


class BlockIndex:
    """Inverted lists over the sets of one block, searched with DivideSkip."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((owner, tokens))
        self.owner, tokens = owner[order], tokens[order]
        self.tokens, self.first = np.unique(tokens, return_index=True)
        self.last = np.append(self.first[1:], len(tokens))

    def search(self, query: np.ndarray, percent: int, skip_cost: float = 4.0) -> np.ndarray:
        """Numbers of the sets whose Jaccard similarity to query is percent or more."""
        n = len(query)
        if not n or not len(self.tokens):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        need = -(-percent * n // 100)  # the least overlap with any set
        if len(at) < need:
            return np.zeros(0, np.int64)
        length = self.last[at] - self.first[at]
        at = at[np.argsort(length, kind="stable")]
        longest = int(self.last[at[-1]] - self.first[at[-1]])
        n_long = min(need - 1, int(need / (skip_cost * math.log(longest + 1) + 1)))
        short, long = at[: len(at) - n_long], at[len(at) - n_long :]
        size = self.last[short] - self.first[short]
        ends = np.cumsum(size)
        met = self.owner[np.repeat(self.first[short] - ends + size, size) + np.arange(ends[-1])]
        count = np.bincount(met, minlength=len(self.sizes))
        found = np.flatnonzero(count >= need - n_long)
        found = found[(100 * self.sizes[found] >= percent * n) & (100 * n >= percent * self.sizes[found])]
        count = count[found]
        for k in long:
            if not len(found):
                break
            held = self.owner[self.first[k] : self.last[k]]
            count += held[np.minimum(np.searchsorted(held, found), len(held) - 1)] == found
        return found[100 * count >= percent * (n + self.sizes[found] - count)]


def _frequent_in(width: int, least: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            many = count >= least
            return pa.RecordBatch.from_arrays([pa.array(token[many].view(np.int64)), pa.array(count[many])], ["token", "df"])

        for batch in batches:
            for s in shingle_sets(batch.column("text"), width):
                held.append(s)
                size += len(s)
                if size > 1_000_000:
                    yield told()
                    held, size = [], 0
        if held:
            yield told()

    return run


def frequent_shingles(docs: DataFrame, width: int, at_least: int = 64, most: int = 1_000_000, local_least: int = 3) -> np.ndarray:
    """Sorted hashes of shingles counted in at_least documents: at most `most` of them (8 MB), the most frequent.

    Counts are gathered over all documents; a run of some million shingles reports those it met local_least times.
    The set only orders lists, so a shingle that is missed costs time but no link.
    """
    counts = docs.mapInArrow(_frequent_in(width, local_least), "token long, df long")
    often = counts.groupBy("token").agg(F.sum("df").alias("df")).where(F.col("df") >= at_least)
    rows = often.orderBy(F.desc("df"), "token").limit(most).select("token").toArrow()
    return np.sort(rows.column("token").to_numpy().astype(np.int64).view(np.uint64))


def _prefixes(width: int, percent: int, frequent):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for batch in batches:
            sizes, one, two, heads, rare, maps = [], [], [], [], [], []
            for s in shingle_sets(batch.column("text"), width):
                sizes.append(len(s))
                one.append(int(s.sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                two.append(int(np.bitwise_xor.reduce(s * np.uint64(0x2545F4914F6CDD1D)).astype(np.int64)) if len(s) else 0)
                maps.append(bitmap(s))
                head = ordered(s, often)[: prefix_length(len(s), percent)] if len(s) else s
                rare.append(int((~known(head, often)).sum()))
                heads.append(head.view(np.int64))
            offsets = np.zeros(len(heads) + 1, np.int32)
            np.cumsum([len(h) for h in heads], out=offsets[1:])
            flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(heads) if heads else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), flat, pa.array(rare, pa.int64()), pa.array(maps, pa.binary())], ["doc_id", "n", "sum", "xor", "prefix", "rare", "bits"])

    return run


def _set_rows(width: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [packed(s) for s in shingle_sets(batch.column("text"), width)]
            n = pa.array([len(x) // 8 for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("token"), n, pa.array(sets, pa.binary())], ["doc_id", "token", "n", "tokens"])

    return run


def linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are as similar as that: the shorter is probed in the longer by bisection."""
    if len(p) > len(q):
        p, q = q, p
    shared = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
    return 100 * shared >= percent * (len(p) + len(q) - shared)


def bitmap(tokens: np.ndarray) -> bytes:
    """One bit for each hash by its low bits, of as many bits as the least power of two that the set fits in (64 at least)."""
    bits = np.zeros(1 << max(6, int(len(tokens) - 1).bit_length()), bool)
    bits[(tokens & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return packed(np.packbits(bits))


def overlap_bound(x: bytes, n: int, y: bytes, m: int) -> int:
    """What sets of n and m can share at most: a bit that only one has stands for a hash that only this one has."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(p), len(q))
    p, q = (np.bitwise_or.reduce(z.reshape(-1, size), 0) for z in (p, q))
    return min(n - int(np.bitwise_count(p & ~q).sum()), m - int(np.bitwise_count(q & ~p).sum()))


def _close(percent: int):
    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = [overlap_bound(x, n, y, m) >= least_overlap(n, m, percent) for x, n, y, m in zip(batch.x, batch.na, batch.y, batch.nb, strict=True)]
            yield batch.loc[kept, ["a", "b"]]

    return run


def _plausible(percent: int):
    """Of each long list's documents those whose bitmap leaves some other document of the list possible."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs_by_key(batches, "token"):
            n = unit.column("n").to_numpy()
            bits = [np.frombuffer(x, np.uint8) for x in unit.column("bits").to_pylist()]
            size = np.array([len(x) for x in bits])
            ok = np.zeros(len(n), bool)
            for wide in np.unique(size).tolist():
                for narrow in np.unique(size[size <= wide]).tolist():
                    own, other = np.flatnonzero(size == wide), np.flatnonzero(size == narrow)
                    q = np.stack([bits[j] for j in other])
                    for i in own.tolist():
                        p = np.bitwise_or.reduce(bits[i].reshape(-1, narrow), 0)
                        most = np.minimum(n[i] - np.bitwise_count(p & ~q).sum(1, dtype=np.int64), n[other] - np.bitwise_count(q & ~p).sum(1, dtype=np.int64))
                        good = (most >= least_overlap(n[i], n[other], percent)) & (other != i)
                        ok[other[good]] = True
                        ok[i] |= good.any()
            if ok.any():
                yield from unit.select(["token", "doc_id", "df"]).filter(pa.array(ok)).to_batches()

    return run


def _verified(percent: int):
    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.x, batch.y, strict=True)]
            yield batch.loc[kept, ["a", "b"]]

    return run


def _block_links(percent: int):
    """Edges that span what each unit's queries are linked to among its members."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs_by_key(batches, "kind", "token", "block", "part"):
            ids = unit.column("doc_id").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in unit.column("tokens").to_pylist()]
            among, queries = (np.flatnonzero(unit.column(c).to_numpy()) for c in ("member", "query"))
            a, b = [], []
            if len(ids) == 2 and len(among) == 2:
                if linked(*sets, percent):
                    a, b = [int(ids[0])], [int(ids[1])]
            elif len(among) and len(queries):
                index, names = BlockIndex([sets[i] for i in among]), ids[among]
                for i in queries.tolist():
                    found = names[index.search(sets[i], percent)]
                    a += [int(ids[i])] * len(found)
                    b += found.tolist()
            star = {x: r for x, r in forest(a, b).items() if x != r}
            yield pa.RecordBatch.from_arrays([pa.array(star.keys(), pa.int64()), pa.array(star.values(), pa.int64())], ["a", "b"])

    return run


def _searched(members: DataFrame, percent: int, block: int, pivots: int, broadcast_bytes: int) -> DataFrame:
    """Edges (a, b) that span the links among the members (kind, token, doc_id, n, tokens) of each (kind, token)."""
    unit = ["kind", "token"]
    sizes = stored(members.groupBy(*unit).agg(F.count("*").alias("size")), "sizes")
    many = sizes.where(F.col("size") > block).select(*unit)
    nothing = [F.lit(0).cast("long").alias("block"), F.lit(0).alias("part"), "doc_id"]

    def found(units: DataFrame) -> DataFrame:
        dealt = units.repartition("kind", "token", "block", "part").sortWithinPartitions("kind", "token", "block", "part")
        return dealt.mapInArrow(_block_links(percent), "a long, b long")

    large = many.limit(1).count() > 0
    small = members.join(small_or_not(many, broadcast_bytes), unit, "left_anti") if large else members
    edges = found(small.select(*unit, *nothing, F.lit(True).alias("member"), F.lit(True).alias("query"), "tokens"))
    if not large:
        return edges

    width = max(math.log(100 / percent), 0.0) + 1e-9
    level = F.floor(F.log("n") / width)
    rows = stored(members.join(small_or_not(many, broadcast_bytes), unit).withColumn("level", level), "large")
    near = F.explode(F.array(*[F.col("level") + k for k in (-1, 0, 1)])).alias("level")
    lots = [F.xxhash64("doc_id", F.lit(k)) for k in range(pivots)]
    drawn = rows.groupBy(*unit, "level").agg(*[F.min(x).alias(f"h{k}") for k, x in enumerate(lots)])
    some = rows.join(small_or_not(drawn, broadcast_bytes), [*unit, "level"]).where(functools.reduce(lambda x, y: x | y, [x == F.col(f"h{k}") for k, x in enumerate(lots)]))
    some = stored(some.select(*unit, near, F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "pivots")
    stars = (
        rows.select(*unit, "level", F.col("doc_id").alias("a"), F.col("tokens").alias("x")).join(small_or_not(some, broadcast_bytes), [*unit, "level"]).where("a <> b")
        .select("a", "b", "x", "y").mapInPandas(_verified(percent), "a long, b long")
    )
    stars = stored(stars, "stars")
    tops = stored(components(stars), "tops")
    named = stored(rows.select(*unit, "level", "doc_id").join(tops.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("top", F.coalesce("component", "doc_id")), "named")
    count = named.groupBy(*unit, "top").agg(F.count("*").alias("size"))
    largest = count.groupBy(*unit).agg(F.max_by("top", F.struct("size", "top")).alias("most"))
    others = stored(named.join(largest, unit).where("top <> most").select(*unit, "doc_id"), "others")
    if others.isEmpty():
        return edges.unionByName(stars)
    blocks = lambda n, most: F.ceil(n / F.lit(most)).cast("int")
    cells = stored(rows.groupBy(*unit, "level").agg(blocks(F.count("*"), block).alias("blocks")), "cells")
    parts = others.groupBy(*unit).agg(blocks(F.count("*"), block).alias("parts"))
    own = F.col("level") * (1 << 20) + F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    index = (
        rows.join(small_or_not(cells, broadcast_bytes), [*unit, "level"]).join(small_or_not(parts, broadcast_bytes), unit)
        .select(*unit, own.alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "doc_id", F.lit(True).alias("member"), F.lit(False).alias("query"), "tokens")
    )
    queries = (
        rows.join(small_or_not(others, broadcast_bytes), [*unit, "doc_id"]).select(*unit, near, "doc_id", "tokens")
        .join(small_or_not(cells, broadcast_bytes), [*unit, "level"]).join(small_or_not(parts, broadcast_bytes), unit)
        .select(*unit, "level", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"), F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), "doc_id", "tokens")
        .select(*unit, (F.col("level") * (1 << 20) + F.col("k")).alias("block"), "part", "doc_id", F.lit(False).alias("member"), F.lit(True).alias("query"), "tokens")
    )
    return edges.unionByName(stars).unionByName(found(index.unionByName(queries)))


def ngram_jaccard_join(documents: DataFrame, width: int = 4, percent: int = 85, short_list: int = 128, block: int = 512, pivots: int = 2, frequent_df: int = 64, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document; component_id is the least doc_id reachable by links.

    short_list: entries up to which an inverted list is merged pair by pair; longer ones are searched in blocks of
    about `block` documents. pivots: documents of a level that all near it are compared with before a search.
    broadcast_bytes: size of narrow rows (shared shingles, ids to verify) up to which they are broadcast; more are
    joined by shuffle. None changes the result.
    """
    docs = keyed(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    context = docs.sparkSession.sparkContext
    frequent = context.broadcast(frequent_shingles(docs.select("text"), width, frequent_df))
    heads = stored(docs.mapInArrow(_prefixes(width, percent, frequent), "doc_id long, n long, sum long, xor long, prefix array<long>, rare long, bits binary"), "prefixes")

    classes = stored(heads.where("n > 0").groupBy("n", "sum", "xor").agg(F.min("doc_id").alias("rep")), "classes")
    reps = small_or_not(classes.select(F.col("rep").alias("doc_id")), broadcast_bytes)
    entries = heads.join(reps, "doc_id", "left_semi").select("doc_id", "n", "rare", F.posexplode("prefix").alias("pos", "token"))
    # Lists of rare shingles are counted where their entries meet; frequent ones, known beforehand, by partial sums.
    few = entries.where("pos < rare").drop("rare").withColumn("df", F.count("*").over(Window.partitionBy("token")))
    often = entries.where("pos >= rare").drop("rare")
    sums = stored(often.groupBy("token").agg(F.count("*").alias("df")), "sums")
    lists = stored(few.unionByName(often.join(small_or_not(sums, broadcast_bytes), "token").select(*few.columns)).where("df > 1"), "lists")

    short = lists.where(F.col("df") <= short_list)
    x, y = (short.select("token", F.col("doc_id").alias(d), F.col("n").alias(f"n{d}"), F.col("pos").alias(f"p{d}")) for d in "ab")
    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
    pairs = (
        x.join(y, "token")
        .where((F.col("a") < F.col("b")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
        .groupBy("a", "b", "na", "nb")
        .agg(F.count("*").alias("met"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
        .where(F.col("met") + F.least(F.col("na") - 1 - F.col("pa"), F.col("nb") - 1 - F.col("pb")) >= need)
        .select("a", "b", "na", "nb")
    )
    pairs = stored(pairs, "pairs")
    x, y = (heads.select(F.col("doc_id").alias(d), F.col("bits").alias(name)) for d, name in (("a", "x"), ("b", "y")))
    close = stored(pairs.join(x, "a").join(y, "b").mapInPandas(_close(percent), "a long, b long"), "close")

    # Documents that hang together by what is left, or by long lists, are a group; linked ones are in one.
    n_blocks = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int")
    long = lists.where(F.col("df") > short_list).select("token", "doc_id", "n", "df")
    middle = small_or_not(stored(long.where(F.col("df") <= block), "middle"), broadcast_bytes)  # bitmaps rule out what no other of the list can link to
    middle = heads.select("doc_id", "bits").join(middle, "doc_id").select("token", "doc_id", "n", "df", "bits").repartition("token").sortWithinPartitions("token")
    middle = middle.mapInArrow(_plausible(percent), "token long, doc_id long, df long")
    long = stored(long.where(F.col("df") > block).select("token", "doc_id", "df").unionByName(middle), "long").select("token", "doc_id", n_blocks("df").alias("blocks"))
    tops = small_or_not(stored(long.groupBy("token").agg(F.min("doc_id").alias("b")), "tops"), broadcast_bytes)
    groups = stored(components(close.unionByName(long.join(tops, "token").select(F.col("doc_id").alias("a"), "b"))), "groups")

    # A group is searched whole where that ships no more sets than its pairs and long lists would.
    spent = long.select("doc_id", "blocks").union(close.select("a", F.lit(2))).groupBy("doc_id").agg(F.sum("blocks").alias("rows"))
    sized = groups.join(spent.withColumnRenamed("doc_id", "node"), "node", "left").groupBy("component").agg(F.count("*").alias("size"), F.sum("rows").alias("rows"))
    sized = stored(sized.withColumn("blocks", n_blocks("size")).where("blocks = 1 or size * blocks <= rows").select("component"), "sized")
    whole = groups.join(small_or_not(sized, broadcast_bytes).withColumn("whole", F.lit(True)), "component", "left")
    wanted = stored(whole.select(F.col("node").alias("doc_id"), F.when(F.col("whole"), F.col("component")).alias("token")), "wanted")
    sets = stored(docs.join(small_or_not(wanted, broadcast_bytes), "doc_id").select("doc_id", "token", "text").mapInArrow(_set_rows(width), "doc_id long, token long, n long, tokens binary"), "sets")
    members = sets.where("token is not null").select(F.lit(0).alias("kind"), "token", "doc_id", "n", "tokens")
    loose = stored(wanted.where("token is null").select("doc_id"), "loose")
    by_pair = None
    if not loose.isEmpty():
        some = small_or_not(loose, broadcast_bytes)
        rest = sets.where("token is null").select("doc_id", "n", "tokens")
        listed = stored(long.select("token", "doc_id").join(some, "doc_id", "left_semi"), "listed")
        members = members.unionByName(rest.join(small_or_not(listed, broadcast_bytes), "doc_id").select(F.lit(1).alias("kind"), "token", "doc_id", "n", "tokens"))
        x, y = (rest.select(F.col("doc_id").alias(d), F.col("tokens").alias(name)) for d, name in (("a", "x"), ("b", "y")))
        by_pair = close.join(some.withColumnRenamed("doc_id", "a"), "a", "left_semi").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(_verified(percent), "a long, b long")
    checked = _searched(members, percent, block, pivots, broadcast_bytes)
    checked = checked if by_pair is None else checked.unionByName(by_pair)
    found = components(checked)
    members = heads.join(classes, ["n", "sum", "xor"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep"))
    return members.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
