"""Byte-level BPE encoding and decoding with a minimal acyclic transducer of frequent words.

Words (the pattern's tokens) are counted over all texts; those that make up a given share of them are compiled, with
the ids that they encode to, into one automaton that shares prefixes and suffixes. Each transition carries an output;
the outputs along a word add up to its place in the list of ids. The automaton lies in a double array in one file of
the shared folder, which Spark hands to the executors and all Python workers of one map into memory. Words are walked
through it in step, a byte a round; words that it doesn't hold are merged exactly, all at once in rounds of the least
rank a word, and very long ones with a heap. Which words are frequent steers only where ids come from, never the ids.

Edge cases: a null or empty text has no ids and decodes to ''; texts that hold a special token's string get its id, as
the library gives; a longer text is worked on by pieces that end before white space (one without any is one piece);
ties and repeated rows don't matter, as each row is encoded alone; rows with a null doc_id go, of rows that repeat a
doc_id the least stays; further columns do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import _hashed, keyed, lean, shared_dir, text_slices

NONE = np.int64(1) << np.int64(40)
LONGEST = 64  # bytes of a word that the transducer may hold
HEAPED = 4096  # symbols from which a word is merged with a heap
PIECE = 1 << 20
OTHER, LETTER, NUMBER, SPACE = range(4)
# The code points with the property White_Space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Endings that an apostrophe splits off.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself where it shows, else a number from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_model(path: str) -> dict:
    """Tokens, merges and special tokens of a byte-level BPE file; ValueError for files with other features."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, before = told["model"], told["pre_tokenizer"] or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    special = {x["content"]: x["id"] for x in told["added_tokens"]}
    if not plain or told["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in told["added_tokens"]):
        raise ValueError("not a plain byte-level BPE file")
    of = byte_characters()
    raw = {t: bytes(of[c] for c in t) for t in model["vocab"] if t not in special}
    tokens = [b""] * (1 + max([*model["vocab"].values(), *special.values()]))
    for t, i in model["vocab"].items():
        tokens[i] = raw[t] if t in raw else t.encode()
    for t, i in special.items():
        tokens[i] = t.encode()
    vocab, merges, last = model["vocab"], [], {}
    for rank, merge in enumerate(model["merges"]):
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        if max(last.get(a, -1), last.get(b, -1)) >= rank or a + b not in vocab:
            raise ValueError("a merge stands before the merges of its parts")
        last[a + b] = rank
        merges.append((vocab[a], vocab[b], vocab[a + b]))
    if any(max(last.get(a, -1), last.get(b, -1)) >= rank for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])):
        raise ValueError("a part has a later merge than the whole")
    own = {bytes([b]): vocab[c] for c, b in of.items()}
    return {"tokens": tokens, "merges": np.array(merges, np.int64).reshape(-1, 3), "bytes": np.array([own[bytes([b])] for b in range(256)], np.int32), "special": special, "classes": classes()}


def classes() -> np.ndarray:
    """Letter, number, white space or other, of each code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE] = SPACE
    return out


_WIDTH = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16, np.int64)
_MASK = np.array([0, 0x7F, 0x1F, 0x0F, 0x07], np.uint32)


def words(data: np.ndarray, cuts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where each word starts, in bytes of UTF-8. cuts: bounds of texts, which no word crosses, first 0 and last len(data)."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    width = _WIDTH[lead]
    point = lead.astype(np.uint32) & _MASK[width]
    for k in (1, 2, 3):
        more = np.flatnonzero(width > k)
        point[more] = point[more] << 6 | (data[at[more] + k] & 0x3F)
    n = len(at)
    kind = kinds[point]
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, cuts)] = True  # at n too
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    run = start[:n].copy()
    # The last of a run of white space stands alone before a word; a blank goes with the word.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n])
    start[last] = True
    start[last[point[last] == 32] + 1] = False
    # An apostrophe that starts a word goes with one of a few endings, and what follows those is a word.
    mark = np.flatnonzero((point == 39) & run & start[:n])
    mark = mark[(mark + 1 < n) & ~first[np.minimum(mark + 1, n)]]
    one = point[mark + 1]
    two = np.where(first[np.minimum(mark + 2, n)], 0, point[np.minimum(mark + 2, n - 1)])
    size = np.where(np.isin(one, [ord(c) for c in SHORT_ENDINGS]), 2, 0)
    for a, b in LONG_ENDINGS:
        size[(one == ord(a)) & (two == ord(b))] = 3
    mark, size = mark[size > 0], size[size > 0]
    start[mark + 1] = False
    start[mark + size] = True
    return at[start[:n]]


def pieces(data: np.ndarray, kinds: np.ndarray, size: int = PIECE) -> Iterator[np.ndarray]:
    """A long text in pieces of about that size that end where white space begins, so that words are the same."""
    raw, at = data.tobytes(), 0
    while len(raw) - at > 2 * size:
        i = at + size
        while True:
            found = [j for j in (raw.find(b" ", i), raw.find(b"\n", i)) if j >= 0]
            if not found:
                i = len(raw)
                break
            i = min(found)
            before = raw[max(0, i - 4) : i].decode("utf-8", "ignore")[-1:]
            if before and kinds[ord(before)] != SPACE:
                break
            i += 1
        yield data[at:i]
        at = i
    if at < len(raw):
        yield data[at:]


class Merger:
    """Exact merges of any words: symbols of all words in one array, the least rank of each word merged a round."""

    def __init__(self, model: dict):
        pair = model["merges"]
        self._bytes = model["bytes"]
        self._slots = 1 << (4 * max(1, len(pair))).bit_length()
        self._key = np.full(self._slots, -1, np.int64)
        self._rank = np.full(self._slots, NONE, np.int64)
        self._to = np.zeros(self._slots, np.int32)
        keys = pair[:, 0] << 32 | pair[:, 1]
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):  # open addressing
            free = left[self._key[at[left]] == -1]
            free = free[np.unique(at[free], return_index=True)[1]]
            self._key[at[free]], self._rank[at[free]], self._to[at[free]] = keys[free], free, pair[free, 2]
            left = left[self._key[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (self._slots - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(36)).astype(np.int64) & (self._slots - 1)

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of each pair; NONE where there is no merge."""
        keys = a.astype(np.int64) << 32 | b
        at = self._slot(keys)
        held = self._key[at]
        left = np.flatnonzero((held != keys) & (held != -1))
        while len(left):
            at[left] = (at[left] + 1) & (self._slots - 1)
            held = self._key[at[left]]
            left = left[(held != keys[left]) & (held != -1)]
        return np.where(self._key[at] == keys, self._rank[at], NONE), self._to[at]

    def merge(self, many: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many) of each word."""
        if not many:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        size = np.array([len(w) for w in many], np.int64)
        long = np.flatnonzero(size > HEAPED)
        short = np.flatnonzero(size <= HEAPED)
        ids, counts = self._rounds(b"".join(many[i] for i in short.tolist()), size[short])
        if not len(long):
            return ids, counts
        parts = dict(zip(short.tolist(), np.split(ids, np.cumsum(counts)[:-1]), strict=True)) if len(short) else {}
        parts |= {i: self._heaped(many[i]) for i in long.tolist()}
        return np.concatenate([parts[i] for i in range(len(many))]), np.array([len(parts[i]) for i in range(len(many))], np.int64)

    def _rounds(self, raw: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sym = self._bytes[np.frombuffer(raw, np.uint8)]
        word = np.repeat(np.arange(len(size)), size)
        rank, to = np.full(len(sym), NONE, np.int64), np.zeros(len(sym), np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], to[inner] = self._look(sym[inner], sym[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            count = np.diff(np.append(start, len(sym)))
            best = np.minimum.reduceat(rank, start)
            live = best < NONE
            if not live.all():
                stay = np.repeat(live, count)
                done.append((sym[~stay], word[~stay]))
                sym, word, rank, to, best, count = sym[stay], word[stay], rank[stay], to[stay], best[live], count[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, count))
            order = np.arange(len(at))
            run = np.maximum.accumulate(np.where(np.append(True, at[1:] != at[:-1] + 1), order, 0))
            at = at[(order - run) % 2 == 0]  # of overlapping ones the first, third, ...
            sym[at] = to[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            rank[at] = NONE
            sym, word, rank, to = sym[keep], word[keep], rank[keep], to[keep]
            now = at - np.arange(len(at))
            for left in (now[now > 0] - 1, now[now + 1 < len(sym)]):
                same = word[left] == word[left + 1]
                rank[left[~same]] = NONE
                left = left[same]
                rank[left], to[left] = self._look(sym[left], sym[left + 1])
        if done:
            sym, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(size)).astype(np.int64)

    def _heaped(self, word: bytes) -> np.ndarray:
        """One long word: pairs in a heap by rank and place, symbols in a linked list."""
        sym = self._bytes[np.frombuffer(word, np.uint8)].tolist()
        pair = dict(zip(self._key[self._key >= 0].tolist(), zip(self._rank[self._key >= 0].tolist(), self._to[self._key >= 0].tolist(), strict=True), strict=True))
        n = len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*pair[k], i, sym[i], sym[i + 1]) for i in range(n - 1) if (k := sym[i] << 32 | sym[i + 1]) in pair]
        heapq.heapify(heap)
        while heap:
            _, to, i, a, b = heapq.heappop(heap)
            j = right[i]
            if j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], sym[j] = to, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x in (left[i], i):
                if x >= 0 and right[x] >= 0 and (k := sym[x] << 32 | sym[right[x]]) in pair:
                    heapq.heappush(heap, (*pair[k], x, sym[x], sym[right[x]]))
        return np.array([s for s in sym if s >= 0], np.int32)


def minimal(lexicon: list[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """(transitions, final) of the least automaton of sorted distinct words: equal ends are one state. State 0 is the start."""
    steps: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []  # (state, byte) of the last word that isn't shared yet
    free: list[int] = []

    def shared(down: int) -> None:
        while len(path) > down:
            state, byte = path.pop()
            child = steps[state][byte]
            key = (final[child], *steps[child].items())
            if (known := register.setdefault(key, child)) != child:
                steps[state][byte] = known
                steps[child] = {}
                free.append(child)

    last = b""
    for word in lexicon:
        same = next((i for i, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
        shared(same)
        state = steps[path[-1][0]][path[-1][1]] if path else 0
        for byte in word[same:]:
            new = free.pop() if free else len(steps)
            if new == len(steps):
                steps.append({})
                final.append(False)
            steps[new], final[new] = {}, False
            steps[state][byte] = new
            path.append((state, byte))
            state = new
        final[state] = True
        last = word
    shared(0)
    return steps, final


class Transducer:
    """A lexicon's automaton in a double array, with outputs that add up to a word's place, and the ids at each place.

    All in one array of 32-bit numbers, so that a file of it can be mapped into memory.
    """

    FIELDS = ("base", "final", "owner", "target", "output", "offsets", "ids")

    def __init__(self, flat: np.ndarray):
        sizes, at = flat[: len(self.FIELDS)].tolist(), len(self.FIELDS)
        for name, n in zip(self.FIELDS, sizes, strict=True):
            setattr(self, name, flat[at : at + n])
            at += n

    @classmethod
    def compiled(cls, lexicon: list[bytes], merger: Merger) -> np.ndarray:
        """The array of a lexicon's automaton; lexicon in any order, empty words left out."""
        lexicon = sorted({w for w in lexicon if w})
        steps, final = minimal(lexicon)
        held: dict[int, int] = {}
        for top in range(len(steps)):  # words that can end from each state, children first
            todo = [top]
            while todo:
                s = todo[-1]
                if s in held:
                    todo.pop()
                elif more := [t for t in steps[s].values() if t not in held]:
                    todo += more
                else:
                    held[s] = final[s] + sum(held[t] for t in steps[s].values())
        base, owner, target, output = np.zeros(len(steps) + 1, np.int32), [], [], []
        size = 4 * sum(map(len, steps)) + 1024
        used = np.zeros(size, bool)
        low = 0
        for s in sorted(range(len(steps)), key=lambda s: -len(steps[s])):
            if not steps[s]:
                continue
            own = np.array(sorted(steps[s]))
            at = max(0, low - int(own[0]))
            while True:  # the first place with room, told for some thousand places at once
                room = np.arange(at, at + 4096)
                if room[-1] + 256 >= len(used):
                    used = np.append(used, np.zeros(len(used) + 8192, bool))
                fits = ~used[room[:, None] + own].any(1) if len(own) < 9 else ~np.logical_or.reduce([used[room + c] for c in own])
                if fits.any():
                    break
                at += 4096
            base[s] = at + int(np.argmax(fits))
            used[base[s] + own] = True
            low += int(np.argmin(used[low:]))
            before = int(final[s])
            for c in own.tolist():
                owner.append((base[s] + c, s))
                target.append(steps[s][c])
                output.append(before)
                before += held[steps[s][c]]
        place = np.array([p for p, _ in owner], np.int64)
        slots = int(base.max(initial=0)) + 257
        laid = np.full((3, slots), -1, np.int32)
        if len(place):
            laid[:, place] = np.array([[s for _, s in owner], target, output])
        ids, counts = merger.merge(lexicon) if lexicon else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        fields = [base, np.array([*final, False], np.int32), *laid, np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), ids]
        return np.concatenate([np.array([len(x) for x in fields]), *fields]).astype(np.int32)

    def places(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Each word's place in the lexicon, -1 where it isn't there: all words walk in step."""
        out = np.full(len(size), -1, np.int64)
        order = np.argsort(-size, kind="stable")
        order = order[np.searchsorted(-size[order], -LONGEST) :]
        start, size = start[order], size[order]
        lost = len(self.base) - 1
        state, place = np.zeros(len(size), np.int32), np.zeros(len(size), np.int32)
        live = len(size)
        bounds = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1 if live else 1), "right")
        for k, live in enumerate(bounds.tolist()):
            slot = self.base[state[:live]] + data[start[:live] + k]
            there = self.owner[slot] == state[:live]
            place[:live] += self.output[slot]
            state[:live] = np.where(there, self.target[slot], lost)
        out[order] = np.where(self.final[state] > 0, place, -1)
        return out


class Codec:
    """Encoder and decoder for buffers of texts, with a transducer and a bounded cache of other words."""

    def __init__(self, model: dict, flat: np.ndarray, cache: int = 50_000):
        self.kinds, self._special, self._cache = model["classes"], {k.encode(): v for k, v in model["special"].items()}, cache
        self._merger, self._lexicon = Merger(model), Transducer(flat)
        self._raw = np.frombuffer(b"".join(model["tokens"]), np.uint8)
        self._len = np.array([len(t) for t in model["tokens"]], np.int64)
        self._off = np.concatenate([[0], np.cumsum(self._len)])[:-1]
        self._reset()

    def _reset(self) -> None:
        self._known: dict[bytes, int] = {}
        self._pool, self._ends = np.array(self._lexicon.ids), np.array(self._lexicon.offsets, np.int64)

    def _parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cuts, where special tokens start, their lengths): texts' bounds and those of special tokens in them."""
        found: list[tuple[int, int]] = []
        raw = data.tobytes()
        if any(k in raw for k in self._special):
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                while a < b:
                    hits = [(i, -len(k)) for k in self._special if (i := raw.find(k, a, b)) >= 0]
                    if not hits:
                        break
                    i, n = min(hits)
                    found.append((i, -n))
                    a = i - n
        at, size = (np.array(x, np.int64) for x in (zip(*found, strict=True) if found else ((), ())))
        return np.unique(np.concatenate([offsets, at, at + size])), at, size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts that lie in data between the offsets."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        cuts, special, length = self._parts(data, offsets)
        start = words(data, cuts, self.kinds)
        if len(special):
            inside = np.searchsorted(special, start, "right") - 1
            start = start[(inside < 0) | (start == special[inside]) | (start >= special[inside] + length[inside])]
        end = np.append(start[1:], len(data))
        place = self._lexicon.places(data, start, end - start)
        unseen = np.flatnonzero(place < 0)
        if len(unseen):
            if len(self._known) > self._cache:
                self._reset()
            raw = data.tobytes()
            other = [raw[a:b] for a, b in zip(start[unseen].tolist(), end[unseen].tolist(), strict=True)]
            if new := [w for w in dict.fromkeys(other) if w not in self._known]:
                ids, counts = self._learned(new)
                first = len(self._ends) - 1
                self._known.update({w: first + i for i, w in enumerate(new)})
                self._pool = np.concatenate([self._pool, ids])
                self._ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum(counts)])
            place[unseen] = np.fromiter(map(self._known.__getitem__, other), np.int64, len(other))
        size = self._ends[place + 1] - self._ends[place]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = self._pool[np.repeat(self._ends[place] - ends[:-1], size) + np.arange(ends[-1])]
        return flat, ends[np.searchsorted(start, offsets)]

    def _learned(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many) of words that are neither in the lexicon nor known; special tokens are not merged."""
        special = [i for i, w in enumerate(new) if w in self._special]
        if not special:
            return self._merger.merge(new)
        ids, counts = self._merger.merge([w for w in new if w not in self._special])
        at = np.array(special) - np.arange(len(special))  # how many other words stand before each
        ids = np.insert(ids, np.concatenate([[0], np.cumsum(counts)])[at], [self._special[new[i]] for i in special])
        return ids, np.insert(counts, at, 1)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a run of ids."""
        size = self._len[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self._raw[np.repeat(self._off[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()

    def encoded(self, column: pa.Array) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
        """(first row, whether the row goes on, ids, offsets) for runs of rows; a long text's ids come in several runs of one row."""
        for at, data, offsets in text_slices(column, PIECE):
            if len(offsets) == 2 and len(data) > 2 * PIECE:
                held = None
                for part in self._long(data):
                    if held is not None:
                        yield at, True, held, np.array([0, len(held)])
                    held = self.encode(part, np.array([0, len(part)]))[0]
                yield at, False, held, np.array([0, len(held)])
            else:
                yield at, False, *self.encode(data, offsets)

    def _long(self, data: np.ndarray) -> Iterator[np.ndarray]:
        cuts, special, length = self._parts(data, np.array([0, len(data)]))
        whole = dict(zip(special.tolist(), length.tolist(), strict=True))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield from [data[a:b]] if a in whole else pieces(data[a:b], self.kinds)


def frequent_words(documents: DataFrame, model: dict, share: float = 1e-5, most: int = 65_536) -> list[bytes]:
    """Up to `most` words of at most LONGEST bytes that make up that share of all words, the most frequent first.

    A word with that share of the whole has it in some run of texts too: so each task tells only the words that have it
    in one of its runs, and their counts there are added up (at least so often they stand in the corpus).
    """
    shared = documents.sparkSession.sparkContext.broadcast(model["classes"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: Counter = Counter()
        for batch in batches:
            for _, data, offsets in text_slices(batch.column("text"), 4 * PIECE):
                for part, cuts in [(data, np.unique(offsets))] if len(data) <= 8 * PIECE else [(p, np.array([0, len(p)])) for p in pieces(data, shared.value)]:
                    if not len(part):
                        continue
                    start = words(part, cuts, shared.value)
                    end = np.append(start[1:], len(part))
                    n = len(start)
                    short = np.flatnonzero(end - start <= LONGEST)
                    if not len(short):
                        continue
                    _, at, counts = np.unique(_hashed(part, start[short], end[short]), return_index=True, return_counts=True)
                    often = np.flatnonzero(counts >= max(2, share * n))
                    raw, at = part.tobytes(), short[at[often]]
                    told.update({raw[a:b]: c for a, b, c in zip(start[at].tolist(), end[at].tolist(), counts[often].tolist(), strict=True)})
        if told:
            yield pa.RecordBatch.from_arrays([pa.array(list(told), pa.binary()), pa.array(list(told.values()), pa.int64())], ["word", "n"])

    counts = documents.select("text").where("text is not null").mapInArrow(run, "word binary, n long")
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return [bytes(r.word) for r in top.collect()]


def shared_lexicon(documents: DataFrame, model: dict, share: float = 1e-5, most: int = 65_536) -> str:
    """Compile the frequent words of documents into a file that all executors get; its name there."""
    spark = documents.sparkSession
    flat = Transducer.compiled(frequent_words(documents, model, share, most), Merger(model))
    name = f"lexicon-{uuid.uuid4().hex}.i32"
    url = f"{shared_dir(spark)}/{name}"
    files, path = pyarrow.fs.FileSystem.from_uri(url)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(path) as out:
        out.write(flat.tobytes())
    spark.sparkContext.addFile(url)
    return name


def _mapped(name: str) -> np.ndarray:
    return np.memmap(SparkFiles.get(name), np.int32, "r")


def encode(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of each document."""
    docs, model = keyed(documents, "doc_id", "text"), read_model(path)
    shared, name = documents.sparkSession.sparkContext.broadcast(model), shared_lexicon(docs, model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, _mapped(name))
        for batch in batches:
            held: list[np.ndarray] = []
            for at, more, ids, offsets in codec.encoded(batch.column("text")):
                held.append(ids)
                if more:
                    continue
                flat = np.concatenate(held) if len(held) > 1 else ids
                offsets = offsets if len(held) == 1 else np.array([0, len(flat)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(offsets) - 1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))], ["doc_id", "ids"])
                held = []

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text, ids outside the vocabulary an error, bytes that are no character U+FFFD."""
    model = read_model(path)
    empty = Transducer.compiled([], Merger(model))
    shared = encoded.sparkSession.sparkContext.broadcast((model, empty))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in batches:
            texts = [codec.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = keyed(encoded, "doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(documents: DataFrame, path: str, share: float = 1e-5, most: int = 65_536) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, then its ids decoded, in one pass."""
    docs, model = keyed(documents, "doc_id", "text"), read_model(path)
    shared, name = documents.sparkSession.sparkContext.broadcast(model), shared_lexicon(docs, model, share, most)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, _mapped(name))
        for batch in batches:
            ids_of, text_of, n = hashlib.sha256(), hashlib.sha256(), 0
            for at, more, ids, offsets in codec.encoded(batch.column("text")):
                size = []
                known, told = [], []
                raw = ids.astype("<u4").tobytes()
                plain = codec.decode(ids)
                ends = np.concatenate([[0], np.cumsum(codec._len[ids])])[offsets].tolist()
                bounds = offsets.tolist()
                for a, b, i, j in zip(bounds, bounds[1:], ends, ends[1:], strict=False):
                    ids_of.update(raw[4 * a : 4 * b])
                    text_of.update(plain[i:j].decode("utf-8", "replace").encode())
                    n += b - a
                    if more:
                        break
                    size.append(n)
                    known.append(ids_of.hexdigest())
                    told.append(text_of.hexdigest())
                    ids_of, text_of, n = hashlib.sha256(), hashlib.sha256(), 0
                if size:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(size)), pa.array(size, pa.int64()), pa.array(known), pa.array(told)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
