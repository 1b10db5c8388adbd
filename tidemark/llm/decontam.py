"""Benchmark decontamination: a BM25 index of the test items, searched with block-max pruning by every training passage.

The index holds an inverted list for each word of the items, with BM25 impacts divided by the item's score against
itself, so a passage's score is the weighted share of the item it holds, and one threshold suits all. Items lie in
blocks; each list has its largest impact per block. A passage (a window twice as long as the longest item, at half
its length each, so that every item lies whole in one) is scored like WAND does it, for many passages at once: words of
many items are the non-essential lists, whose block maxima are summed beforehand as a bound; only the essential lists
are walked; blocks whose bound stays below the threshold are skipped; the items of the rest are scored in full and all
at or above it retrieved. A retrieved item is verified by shingles of five words: `overlap` of all and at least
`part_overlap` of the question's and of the answer's must stand in the passage; or else the same shares of the words
themselves, with the item laid word by word against one place of the passage: a changed word spoils five shingles, more
than `overlap` lets go in an item of fewer than 29 words, and parts under five words have no shingle. The answer is the
item's last sentence of five words or more, the question what stands before it.

The index is broadcast in shards of at most shard_items items, one pass over the documents for each; documents are
never shuffled. Edge cases: null or empty texts and items match nothing; an item of fewer than five words is found by
its words alone; a word put in or left out of an item of fewer than 24 words hides it; rows with a null id go, of rows
that repeat one the least stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import keyed, lean, shingle_hashes, text_slices, word_hashes

WIDTH = 5
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def plain(text: str | None) -> bytes:
    """Lower case, without ASCII punctuation, in UTF-8."""
    return (text or "").lower().encode().translate(None, _PUNCTUATION)


def words_of(text: str) -> np.ndarray:
    """Word hashes of a text, in lower case without punctuation."""
    raw = plain(text)
    return word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]


def answer_start(text: str, words: np.ndarray) -> int:
    """Number of the answer's first word; what stands before it is the question."""
    sentences = [len(words_of(s)) for s in re.split(r"(?<=[.!?])\s+", text)]
    tail = 0
    for n in reversed(sentences):
        tail += n
        if tail >= WIDTH:
            break
    return len(words) - tail if len(words) - tail >= WIDTH else len(words) // 2


def _expand(start: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all entries of the lists, and the number of the list in `lists` that each is of."""
    size = start[lists + 1] - start[lists]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(start[lists] - ends + size, size) + np.arange(total), np.repeat(np.arange(len(lists)), size)


class ItemIndex:
    """BM25 inverted lists with block maxima over (item_id, text) pairs."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, block: int = 8, common: float = 0.1, k1: float = 1.2, b: float = 0.75):
        items = [(i, t, w) for i, t in items if t and len(w := words_of(t))]
        self.ids = [i for i, _, _ in items]
        self.words = [w for _, _, w in items]
        self.cut = [answer_start(t, w) for _, t, w in items]
        self.parts = [tuple(np.unique(shingle_hashes(p, WIDTH)) for p in (w[:k], w[k:])) for w, k in zip(self.words, self.cut, strict=True)]
        self.whole = [np.unique(shingle_hashes(w, WIDTH)) for _, _, w in items]
        self.threshold, self.block = threshold, block
        self.n_blocks = -(-len(items) // block)
        self.passage = 2 * max((len(w) for _, _, w in items), default=1)
        term, item, impact = [], [], []
        mean = np.mean([len(w) for _, _, w in items]) if items else 1.0
        for i, (_, _, w) in enumerate(items):
            own, tf = np.unique(w, return_counts=True)
            term.append(own)
            item.append(np.full(len(own), i))
            impact.append(tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(w) / mean)))
        term, item, impact = (np.concatenate(x) if items else np.zeros(0, k) for x, k in ((term, np.uint64), (item, np.int64), (impact, float)))
        self.terms, which, df = np.unique(term, return_inverse=True, return_counts=True)
        impact = impact * np.log(1 + (len(items) - df[which] + 0.5) / (df[which] + 0.5))
        impact = impact / np.bincount(item, impact, minlength=max(1, len(items)))[item] if items else impact
        order = np.lexsort((item, which))
        self.item, self.impact = item[order], impact[order]
        self.start = np.searchsorted(which[order], np.arange(len(self.terms) + 1))
        self.essential = df <= max(2, common * len(items))
        # No item may reach the threshold by non-essential lists alone: its rarest one becomes essential until none does.
        sorted_terms = which[order]
        while len(items):
            idle = ~self.essential[sorted_terms]
            over = np.bincount(self.item[idle], self.impact[idle], minlength=len(items)) >= threshold - 1e-9
            if not over.any():
                break
            rows = np.flatnonzero(idle & over[self.item])
            rows = rows[np.lexsort((sorted_terms[rows], df[sorted_terms[rows]], self.item[rows]))]
            own = self.item[rows]
            self.essential[sorted_terms[rows[np.concatenate([[True], own[1:] != own[:-1]])]]] = True
        group = which[order] * max(1, self.n_blocks) + self.item // block
        at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        self.block_of, self.block_max = self.item[at] // block, np.maximum.reduceat(self.impact, at) if len(at) else np.zeros(0)
        self.block_start = np.searchsorted(which[order][at], np.arange(len(self.terms) + 1))
        idle = ~self.essential[which[order][at]] if len(at) else np.zeros(0, bool)
        self.idle_bound = np.bincount(self.block_of[idle], self.block_max[idle], minlength=self.n_blocks)
        rest = ~self.essential[which[order]]
        self.idle_item = np.bincount(self.item[rest], self.impact[rest], minlength=len(items))

    def search(self, words: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[tuple[int, int, float]]:
        """(passage, item, score) at or above the threshold; passages are runs of the word hashes."""
        if not len(self.terms) or not len(words):
            return []
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        known = self.terms[at] == words
        hit = np.flatnonzero(known & self.essential[at])
        span = np.stack([np.searchsorted(hit, start), np.searchsorted(hit, start + size)], 1)
        count = span[:, 1] - span[:, 0]
        ends = np.cumsum(count)
        where = hit[np.repeat(span[:, 0] - ends + count, count) + np.arange(ends[-1])]
        pair = np.unique(np.repeat(np.arange(len(start)), count) * len(self.terms) + at[where])
        p, t = pair // len(self.terms), pair % len(self.terms)
        least = self.threshold - 1e-9
        # Blocks first: what the largest impacts could add up to.
        post, owner = _expand(self.block_start, t)
        key, back = np.unique(p[owner] * self.n_blocks + self.block_of[post], return_inverse=True)
        if not len(key):
            return []
        hope = key[np.bincount(back, self.block_max[post]) + self.idle_bound[key % self.n_blocks] >= least]
        # Then the items of the blocks that are left.
        stay = np.isin(p, np.unique(hope // self.n_blocks))
        p, t = p[stay], t[stay]
        post, owner = _expand(self.start, t)
        inside = np.isin(p[owner] * self.n_blocks + self.item[post] // self.block, hope)
        post, owner = post[inside], owner[inside]
        key, back = np.unique(p[owner] * len(self.ids) + self.item[post], return_inverse=True)
        score = np.bincount(back, self.impact[post], minlength=len(key))
        near = score + self.idle_item[key % max(1, len(self.ids))] >= least
        out = []
        for one, got in zip(key[near].tolist(), score[near].tolist(), strict=True):
            number, item = divmod(one, len(self.ids))
            own = slice(start[number], start[number] + size[number])
            for k in np.unique(at[own][known[own]]).tolist():
                if not self.essential[k]:
                    i = self.start[k] + np.searchsorted(self.item[self.start[k] : self.start[k + 1]], item)
                    got += float(self.impact[i]) if i < self.start[k + 1] and self.item[i] == item else 0.0
            if got >= least:
                out.append((number, item, got))
        return out


def _share(part: np.ndarray, there: np.ndarray) -> float:
    return float(np.isin(part, there).mean()) if len(part) else 1.0


def laid(words: np.ndarray, cut: int, passage: np.ndarray, overlap: float, part_overlap: float) -> bool:
    """Whether at one place of the passage enough of an item's words, and of both its parts, stand word by word."""
    pad = np.zeros(len(words) - 1, np.uint64)  # an item may hang over either end
    same = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, passage, pad]), len(words)) == words
    good = same.mean(1) >= overlap
    for part in (same[:, :cut], same[:, cut:]):
        good &= part.mean(1) >= part_overlap if part.shape[1] else True
    return bool(good.any())


def _scan(index, overlap: float, part_overlap: float, carry: tuple[str, ...] = ()):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: ItemIndex = index.value
        step = ix.passage // 2
        for batch in batches:
            hits: list[dict[int, float]] = [{} for _ in range(len(batch))]
            texts = pa.array([plain(x.as_py()) for x in batch.column("text")], pa.binary()).cast(pa.string())
            for first, data, offsets in text_slices(texts):
                words, _, _, bounds = word_hashes(data, offsets)
                n = np.diff(bounds)
                per_text = np.maximum(1, -(-(n - ix.passage) // step) + 1)
                owner = np.repeat(np.arange(len(n)), per_text)
                ends = np.cumsum(per_text)
                start = bounds[owner] + step * (np.arange(len(owner)) - (ends - per_text)[owner])
                size = np.minimum(start + ix.passage, bounds[owner + 1]) - start
                for number, item, score in ix.search(words, start, size):
                    own = words[start[number] : start[number] + size[number]]
                    there = shingle_hashes(own, WIDTH)
                    question, answer = ix.parts[item]
                    shared = _share(ix.whole[item], there) >= overlap and min(_share(question, there), _share(answer, there)) >= part_overlap
                    if shared or laid(ix.words[item], ix.cut[item], own, overlap, part_overlap):
                        held = hits[first + int(owner[number])]
                        held[ix.ids[item]] = max(score, held.get(ix.ids[item], 0.0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([sorted(h) for h in hits], pa.list_(pa.int64())), pa.array([max(h.values(), default=0.0) for h in hits], pa.float64()), *(batch.column(c) for c in carry)], ["doc_id", "item_ids", "best_score", *carry])

    return run


def decontaminate(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8, part_overlap: float = 0.5, shard_items: int = 20_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, best_score) of each document, and the columns to carry along."""
    docs = keyed(documents, "doc_id", *dict.fromkeys(("text", *carry)))
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    items = keyed(benchmark, "item_id", "text").select(F.col("item_id").cast("long"), "text")
    shards = max(1, -(-items.count() // shard_items))
    found = None
    for k in range(shards):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k)
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(sorted((r.item_id, r.text) for r in own.collect()), threshold))
        part = docs.mapInArrow(_scan(index, overlap, part_overlap, carry), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_ids array<long>, best_score double{more}")
        found = part if found is None else found.unionByName(part)
    if shards > 1:
        found = found.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), F.max("best_score").alias("best_score"), *[F.first(c).alias(c) for c in carry])
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", F.round("best_score", 4).alias("best_score"), *carry)
