"""Suffix-array dedup with a run-length index: remove bytes of long strings that also start earlier in the corpus.

1. *Fragments.* Every window of `length` bytes owns the least-hashed k-gram inside it (its anchor), so equal windows
   own equal anchors. Neighbouring windows with one anchor are a fragment. A map task keeps the first of equal
   fragments and reports the others as repeats at once; what is left is dealt by anchor hash, packed in arrays.
2. *Copies.* A bucket finds the corpus-wide first of equal fragments; the rest are repeats whole. Anchors with
   different fragments left are where a match begins or ends; only those fragments' bytes are fetched.
3. *Index.* The fetched fragments of a bucket are joined, cut at anchor bounds, into texts of about 256 KB. Each
   text gets a run-compressed Burrows-Wheeler transform with the suffix positions at run ends and the common-prefix
   lengths there; from these samples the matching statistics of every position (where the neighbouring suffix
   starts, how long it agrees) are streamed in text order, and windows that agree over `length` with an earlier start
   are marked.

Anchors in the thick of one very frequent passage would put a fragment of each document into one bucket. Those with some
hundreds of different fragments in the whole corpus (told from the one in SAMPLED of all contents, by hash) are resolved
by window hash instead: first in the map task, then by bucket. So what one anchor brings to a bucket is bounded however
large the corpus grows.

Fragments (of some 170 bytes at most) and windows are told apart by 64-bit hashes, the index compares bytes. Edge cases: null text is empty; texts shorter than `length` lose nothing; rows with a null doc_id
go, of rows that repeat a doc_id the least stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import SpanHash, keyed, lean, packed, stored, window_slices

GRAM = 32
SAMPLED = 32
_POS = np.uint64((1 << 28) - 1)


class RunLengthIndex:
    """Run-compressed transform of a byte string, with samples at run ends.

    Common prefixes shorter than `least` are told as 0.
    """

    def __init__(self, text: np.ndarray, least: int = 1):
        n = len(text)
        self.n, self.text, self.least = n, text, least
        order = self._suffixes(text)
        before = text[order - 1]  # of suffix 0 the last byte: the string is read as a ring
        head = np.concatenate([[True], (before[1:] != before[:-1]) | (order[1:] == 0) | (order[:-1] == 0)])
        self.run_start = np.flatnonzero(head)
        self.run_byte = before[self.run_start]
        # phi(i), the suffix before i in the order, is phi(i - 1) + 1 unless suffix i is the first of a run.
        self.end_sample = order[np.append(self.run_start[1:], n) - 1]
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        sample = np.union1d(order[self.run_start], [0])
        rank = place[sample]
        self.sample = sample
        self.phi_of = np.where(rank > 0, order[rank - 1], -1)
        self.common = self._agree(sample, self.phi_of)

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix order by prefix doubling from eight bytes; each round sorts what is still tied."""
        n = len(text)
        pad = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for i in range(8):
            key = (key << np.uint64(8)) | pad[i : i + n]
        order = np.argsort(key, kind="stable")
        tail = np.arange(max(0, n - 8), n)  # a string that ends sorts before its extensions, which padding can't tell
        lead = key[order]
        new = np.concatenate([[True], lead[1:] != lead[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = start
        at = np.flatnonzero(~(new & np.append(new[1:], True)))
        width = 0 if np.isin(tail, order[at]).any() else 8
        while len(at):
            own = order[at]
            if width:
                nxt, step = np.where(own + width < n, rank[np.minimum(own + width, n - 1)] + 1, 0), 2 * width
            else:  # once, by what is left of the string
                nxt, step = np.minimum(n - own, 8), 8
            both = rank[own] * np.int64(n + 1) + nxt
            by = np.argsort(both, kind="stable")
            own, both = own[by], both[by]
            order[at] = own
            new = np.concatenate([[True], both[1:] != both[:-1]])
            rank[own] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            at = at[~(new & np.append(new[1:], True))]
            width = step
        return order

    def _agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a and b (0 where b is -1), by comparing 32 bytes of all at a time."""
        out = np.zeros(len(a), np.int64)
        at = np.flatnonzero((b >= 0) & (self.n - np.maximum(a, b) >= self.least))
        a, b = a[at], b[at]
        size = self.n - np.maximum(a, b)
        lanes = np.lib.stride_tricks.sliding_window_view(np.concatenate([self.text, np.zeros(32, np.uint8)]), 32)
        done = 0
        while len(at):
            differ = lanes[a + done] != lanes[b + done]
            any_ = differ.any(1)
            same = np.where(any_, differ.argmax(1), 32)
            out[at] = np.minimum(done + same, size)
            done += 32
            on = ~any_ & (size > done)
            at, a, b, size = at[on], a[on], b[on], size[on]
        return np.where(out >= self.least, out, 0)

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each position: the neighbouring suffix before it in the order (-1: none) and how long both agree."""
        at = np.arange(self.n)
        k = np.searchsorted(self.sample, at, "right") - 1
        step = at - self.sample[k]
        source = np.where(self.phi_of[k] >= 0, self.phi_of[k] + step, -1)
        agree = self.common[k] - step
        return source, np.where(agree >= self.least, agree, 0)

    def repeats(self, length: int) -> np.ndarray:
        """Whether the string of that length at each position also starts earlier."""
        source, agree = self.matching_statistics()
        top = np.arange(self.n)
        linked = (agree >= length) & (source >= 0)
        top[linked] = source[linked]
        while (further := top[top] != top).any():
            top[further] = top[top][further]
        first = np.full(self.n, self.n)
        np.minimum.at(first, top, np.arange(self.n))
        return np.arange(self.n) > first[top]


def fragments(data: np.ndarray, offsets: np.ndarray, length: int):
    """(spans, text number, first window, last window, anchor hash), the latter four by fragment, windows by start."""
    spans = SpanHash(data)
    none = np.zeros(0, np.int64)
    n = len(data) - length + 1
    if n <= 0:
        return spans, none, none, none, np.zeros(0, np.uint64)
    grams = spans.windows(GRAM)
    key = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
    width, least = 1, key
    span = length - GRAM + 1
    while 2 * width <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    rest = span - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    start = np.arange(n)
    doc = np.searchsorted(offsets, start, "right") - 1
    ok = start + length <= offsets[doc + 1]
    start, doc, anchor = start[ok], doc[ok], (least[ok] & _POS).astype(np.int64)
    if not len(start):
        return spans, none, none, none, np.zeros(0, np.uint64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.append(new[1:], len(start)) - 1
    return spans, doc[new], start[new], start[last], grams[anchor[new]]


def _sampled(length: int):
    """(anchor, content) of the fragments whose content's hash falls to the sample, each once a slice."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in window_slices(batch.column("text"), length):
                spans, _, first, last, anchor = fragments(data, offsets, length)
                content = spans.of(first, last + length)
                own = content % np.uint64(SAMPLED) == 0
                content, at = np.unique(content[own], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[own][at].view(np.int64)), pa.array(content.view(np.int64))], ["anchor", "content"])

    return run


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching spans, by text."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    big = int(end.max()) + 1
    text = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    reach = np.maximum.accumulate(text * big + end) - text * big
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])]))
    return doc[new], start[new], reach[np.append(new[1:], len(doc)) - 1]


def _span_rows(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """One row a text: its spans, as pairs of 64-bit integers."""
    doc, start, end = _merged(doc, start, end)
    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    pairs = np.stack([start, end], 1) if len(doc) else np.zeros((0, 2), np.int64)
    cuts = np.append(at, len(doc))
    return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array([packed(pairs[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], ["doc_id", "spans"])


def _first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether first of its group) by all keys but the last two, which break ties."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys[:-2]:
            new[1:] |= k[order][1:] != k[order][:-1]
    return order, new


_S1 = "bucket long, doc_id long, spans binary, frags binary, wins binary"


def _cut(length: int, buckets: int, frequent):
    def rows(frags: np.ndarray, wins: np.ndarray, done: list) -> Iterator[pa.RecordBatch]:
        """frags: anchor, content, doc, start, windows; wins: hash, doc, start: both as columns of 64-bit integers."""
        out = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("spans", pa.binary()), ("frags", pa.binary()), ("wins", pa.binary())])
        order, new = _first_of(frags[0], frags[1], frags[2], frags[3])
        frags, again = frags[:, order[new]], frags[:, order[~new]]
        done.append((again[2], again[3], again[3] + again[4] - 1 + length))
        order, new = _first_of(wins[0], wins[1], wins[2])
        wins, again = wins[:, order[new]], wins[:, order[~new]]
        done.append((again[1], again[2], again[2] + length))
        spans = _span_rows(*(np.concatenate(x) for x in zip(*done, strict=True)))
        if len(spans):
            none = pa.nulls(len(spans), pa.binary())
            own = pa.array(spans.column("doc_id").to_numpy() % buckets)
            yield pa.RecordBatch.from_arrays([own, spans.column("doc_id"), spans.column("spans"), none, none], schema=out)
        for table, column in ((frags, 3), (wins, 4)):
            if not table.shape[1]:
                continue
            to = (table[0].view(np.uint64) >> np.uint64(8)) % np.uint64(buckets)
            order = np.argsort(to, kind="stable")
            names, at = np.unique(to[order], return_index=True)
            cuts = np.append(at, len(order))
            blobs = pa.array([packed(table[:, order[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())
            none = pa.nulls(len(names), pa.binary())
            columns = [pa.array(names.astype(np.int64)), pa.nulls(len(names), pa.int64()), none, none, none]
            columns[column] = blobs
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        frags, wins, size, held = [], [], 0, 0

        def flush():
            f = np.concatenate(frags, 1) if frags else np.zeros((5, 0), np.int64)
            w = np.concatenate(wins, 1) if wins else np.zeros((3, 0), np.int64)
            return rows(f, w, [])

        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for at, place, data, offsets in window_slices(batch.column("text"), length):
                spans, doc, first, last, anchor = fragments(data, offsets, length)
                if not len(doc):
                    continue
                base = offsets[doc] - place
                hot = np.zeros(len(doc), bool)
                if len(often):
                    hot = often[np.minimum(np.searchsorted(often, anchor), len(often) - 1)] == anchor
                cold = ~hot
                content = spans.of(first[cold], last[cold] + length)
                frags.append(np.stack([anchor[cold].view(np.int64), content.view(np.int64), ids[at + doc[cold]], first[cold] - base[cold], last[cold] - first[cold] + 1]))
                if hot.any():
                    many = last[hot] - first[hot] + 1
                    ends = np.cumsum(many)
                    start = np.repeat(first[hot] - ends + many, many) + np.arange(ends[-1])
                    owner = np.repeat(doc[hot], many)
                    wins.append(np.stack([spans.of(start, start + length).view(np.int64), ids[at + owner], start - offsets[owner] + place]))
                    held += wins[-1].nbytes
                held += frags[-1].nbytes
                size += len(data)
                if size > 1 << 24 or held > 1 << 25:  # windows of frequent anchors are a row a byte of text
                    yield from flush()
                    frags, wins, size, held = [], [], 0, 0
        if frags or wins:
            yield from flush()

    return run


def _copies(length: int, buckets: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frags, wins = [np.zeros((5, 0), np.int64)], [np.zeros((3, 0), np.int64)]
        for batch in batches:
            held = batch.filter(batch.column("spans").is_valid())
            if len(held):
                yield pa.RecordBatch.from_arrays([held.column("doc_id"), held.column("spans"), pa.nulls(len(held), pa.binary())], ["doc_id", "spans", "asked"])
            frags += [np.frombuffer(x, np.int64).reshape(5, -1) for x in batch.column("frags").drop_null().to_pylist()]
            wins += [np.frombuffer(x, np.int64).reshape(3, -1) for x in batch.column("wins").drop_null().to_pylist()]
        f, w = np.concatenate(frags, 1), np.concatenate(wins, 1)
        del frags, wins
        order, new = _first_of(w[0], w[1], w[2])
        again = w[:, order[~new]]
        done = [(again[1], again[2], again[2] + length)]
        order, new = _first_of(f[0], f[1], f[2], f[3])
        first, again = f[:, order[new]], f[:, order[~new]]
        done.append((again[2], again[3], again[3] + again[4] - 1 + length))
        spans = _span_rows(*(np.concatenate(x) for x in zip(*done, strict=True)))
        if len(spans):
            yield pa.RecordBatch.from_arrays([*spans.columns, pa.nulls(len(spans), pa.binary())], ["doc_id", "spans", "asked"])
        same = np.zeros(first.shape[1], bool)
        if len(same) > 1:
            pair = first[0][1:] == first[0][:-1]
            same[1:] |= pair
            same[:-1] |= pair
        asked = first[:, same]
        asked = asked[:, np.argsort(asked[2], kind="stable")]
        names, at = np.unique(asked[2], return_index=True)
        cuts = np.append(at, asked.shape[1])
        if len(names):
            blobs = [packed(asked[[0, 3, 4], a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.nulls(len(names), pa.binary()), pa.array(blobs, pa.binary())], ["doc_id", "spans", "asked"])

    return run


def _fetch(length: int, buckets: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, asks in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("asked").to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                for blob in asks:
                    for anchor, start, many in np.frombuffer(blob, np.int64).reshape(3, -1).T.tolist():
                        out.append(((anchor % (1 << 64) >> 8) % buckets, anchor, doc, start, raw[start : start + many - 1 + length]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], ["bucket", "anchor", "doc_id", "start", "bytes"])

    return run


def _mark(length: int, text_bytes: int = 1 << 18):
    gap = b"\xff"  # in no UTF-8 text

    def marked(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows.sort(key=lambda r: r[1:3])
        sizes = np.array([len(r[3]) for r in rows])
        at = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        again = RunLengthIndex(np.frombuffer(gap.join(r[3] for r in rows) + gap, np.uint8), length).repeats(length)
        many = sizes - length + 1
        ends = np.cumsum(many)
        inside = np.arange(ends[-1]) - np.repeat(ends - many, many)
        hit = again[np.repeat(at, many) + inside]
        doc, start = np.repeat([r[1] for r in rows], many)[hit], (np.repeat([r[2] for r in rows], many) + inside)[hit]
        return _merged(doc.astype(np.int64), start, start + length)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if len(b)]
        if not tables:
            return
        table = pa.Table.from_batches(tables).sort_by([("anchor", "ascending")])
        anchors = table.column("anchor").to_numpy()
        done, held, size = [], [], 0
        for i, row in enumerate(zip(anchors.tolist(), table.column("doc_id").to_pylist(), table.column("start").to_pylist(), table.column("bytes").to_pylist(), strict=True)):
            if held and size > text_bytes and anchors[i] != anchors[i - 1]:
                done.append(marked(held))
                held, size = [], 0
            held.append(row)
            size += len(row[3])
        done.append(marked(held))
        yield _span_rows(*(np.concatenate(x) for x in zip(*done, strict=True)))

    return run


def _kept(keep_text: bool):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, found in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                pairs = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in found or []] or [np.zeros((0, 2), np.int64)])
                _, start, end = _merged(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
                cuts = [0, *np.stack([start, end], 1).ravel().tolist(), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(start), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep_text else None))
            n, removed, spans, digest, kept = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(digest, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return run


def suffix_dedup(documents: DataFrame, length: int = 100, keep_text: bool = False, bucket_bytes: int = 8 << 20, frequent_kinds: int = 128, most_frequent: int = 1_000_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text) of each document; kept_text is null unless asked for,
    and without characters that were cut.

    Bytes covered by a string of `length` bytes that also starts earlier (smaller doc_id, or same document and earlier)
    are removed. bucket_bytes: text behind one bucket. frequent_kinds: different fragments of one anchor (as the sample
    tells) that make it frequent; of more than most_frequent such anchors the rarest stay with their fragments. None
    changes the result.
    """
    docs = keyed(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    context = docs.sparkSession.sparkContext
    kinds = docs.select("text").mapInArrow(_sampled(length), "anchor long, content long").distinct().groupBy("anchor").agg(F.count("*").alias("n"))
    often = kinds.where(F.col("n") >= -(-frequent_kinds // SAMPLED))
    anchors = often.orderBy(F.desc("n"), "anchor").limit(most_frequent).select("anchor").toArrow().column("anchor").to_numpy()
    frequent = context.broadcast(np.sort(anchors.astype(np.int64).view(np.uint64)))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, total // bucket_bytes)
    cut = docs.mapInArrow(_cut(length, buckets, frequent), _S1).repartition(buckets, "bucket")
    found = stored(cut.mapInArrow(_copies(length, buckets), "doc_id long, spans binary, asked binary"), "copies")

    texts = docs.repartition(buckets, "doc_id")
    asked = found.where("asked is not null").groupBy("doc_id").agg(F.collect_list("asked").alias("asked"))
    fetched = texts.join(asked, "doc_id").mapInArrow(_fetch(length, buckets), "bucket long, anchor long, doc_id long, start long, bytes binary")
    marked = stored(fetched.repartition(buckets, "bucket").mapInArrow(_mark(length), "doc_id long, spans binary"), "marked")
    spans = found.where("spans is not null").select("doc_id", "spans").unionByName(marked)
    by_doc = spans.groupBy("doc_id").agg(F.collect_list("spans").alias("spans"))  # a document's own spans
    return texts.join(by_doc, "doc_id", "left").mapInArrow(_kept(keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
