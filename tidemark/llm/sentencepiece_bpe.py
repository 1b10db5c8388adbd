"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text becomes segments, each a run of the space mark and what follows it; no piece of the vocabulary crosses their
bounds (checked when the model is read), so each distinct segment is encoded once a batch. All segments' symbols lie
in one flat array. A round finds each segment's best pair level by a segmented minimum, merges the leftmost pairs of
that level that don't overlap in every segment at once, and compacts; segments without a pair leave. Where a merged
piece could itself make a pair as good or better (told by the vocabulary), only the leftmost is merged in that round:
so the order is that of the reference algorithm, for segments of any length.

Edge cases: a null or empty text has the begin and end ids only and decodes to ''; ties and repeated rows don't
matter, as each row is encoded alone; rows with a null doc_id go, of rows that repeat a doc_id the least stays.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm._common import keyed, lean

MARK = "▁"
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_NONE = np.int64(1) << np.int64(30)


def read_model(path: str) -> dict:
    """Pieces, scores and kinds of a BPE model with byte fallback and plain normalisation; ValueError for others."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    kind = ["byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "normal" for i in range(len(pieces))]
    if any(MARK in p.lstrip(MARK) for p, k in zip(pieces, kind, strict=True) if k == "normal"):
        raise ValueError("a piece holds a space mark after another character")
    if kind.count("byte") != 256 or model.encode("a  ﬁ", out_type=str)[-1] == "fi" or model.decode(model.encode(" a  b ")) != " a  b " or not model.encode("a", out_type=str)[0].startswith(MARK):
        raise ValueError("not a model with byte fallback, a dummy prefix and plain normalisation")
    return {"pieces": pieces, "scores": [model.get_score(i) for i in range(len(pieces))], "kind": kind, "bos": model.bos_id(), "eos": model.eos_id()}


class Codec:
    """Encoder and decoder for lists of texts."""

    def __init__(self, model: dict, cache: int = 50_000):
        self.bos, self.eos, self._cache_size = model["bos"], model["eos"], cache
        normal = {p: i for i, (p, k) in enumerate(zip(model["pieces"], model["kind"], strict=True)) if k == "normal"}
        self.n_pieces = len(model["pieces"])
        level = {s: r for r, s in enumerate(sorted({model["scores"][i] for i in normal.values()}, reverse=True))}
        self._char = {p: i for p, i in normal.items() if len(p) == 1}
        self._byte_ids = np.zeros(256, np.int32)
        self._bytes: list[bytes] = []
        for i, (p, k) in enumerate(zip(model["pieces"], model["kind"], strict=True)):
            if k == "byte":
                self._byte_ids[int(p[3:5], 16)] = i
                self._bytes.append(bytes([int(p[3:5], 16)]))
            else:
                self._bytes.append(p.replace(MARK, " ").encode() if k == "normal" else b"")
        self._is_byte = np.array([k == "byte" for k in model["kind"]])
        pairs = {}
        for p, i in normal.items():
            for cut in range(1, len(p)):
                if p[:cut] in normal and p[cut:] in normal:
                    pairs[normal[p[:cut]] * self.n_pieces + normal[p[cut:]]] = (i, level[model["scores"][i]])
        least = np.full(self.n_pieces, _NONE, np.int64)  # the best level of a pair with the piece in it
        for key, (_, rank) in pairs.items():
            for side in divmod(key, self.n_pieces):
                least[side] = min(least[side], rank)
        own = np.full(self.n_pieces, _NONE, np.int64)
        for p, i in normal.items():
            own[i] = level[model["scores"][i]]
        self._plain = least > own
        keys = np.array(sorted(pairs), np.int64)
        self._slots = 1 << (4 * len(keys)).bit_length()
        self._key = np.full(self._slots, -1, np.int64)
        self._merged = np.zeros(self._slots, np.int32)
        self._level = np.full(self._slots, _NONE, np.int64)
        at = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self._key[at[left]] == -1
            first = np.unique(at[left[free]], return_index=True)[1]
            won = left[free][first]
            self._key[at[won]] = keys[won]
            self._merged[at[won]] = [pairs[k][0] for k in keys[won].tolist()]
            self._level[at[won]] = [pairs[k][1] for k in keys[won].tolist()]
            left = left[self._key[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (self._slots - 1)
        lengths = np.array([len(b) for b in self._bytes])
        self._piece_len = lengths
        self._piece_off = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        self._piece_raw = np.frombuffer(b"".join(self._bytes), np.uint8)
        self._reset()

    def _reset(self) -> None:
        self._known: dict[str, int] = {}
        self._ids = np.zeros(0, np.int32)
        self._off = np.zeros(1, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (self._slots - 1)

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(merged piece, level) of each pair; level _NONE where there is none."""
        keys = np.where((a >= 0) & (b >= 0), a.astype(np.int64) * self.n_pieces + b, -2)
        at = self._slot(keys)
        held = self._key[at]
        left = np.flatnonzero((held != keys) & (held != -1))
        while len(left):
            at[left] = (at[left] + 1) & (self._slots - 1)
            held = self._key[at[left]]
            left = left[(held != keys[left]) & (held != -1)]
        hit = self._key[at] == keys
        return np.where(hit, self._merged[at], -1), np.where(hit, self._level[at], _NONE)

    def _rounds(self, sym: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge until no segment holds a pair. Returns symbols and counts, segments in the order given."""
        seg = np.repeat(np.arange(len(counts)), counts)
        merged, level = np.full(len(sym), -1, np.int32), np.full(len(sym), _NONE, np.int64)
        inside = np.flatnonzero(seg[:-1] == seg[1:])
        merged[inside], level[inside] = self._lookup(sym[inside], sym[inside + 1])
        done_sym, done_seg = [], []
        while len(sym):
            start = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            size = np.diff(np.append(start, len(sym)))
            best = np.minimum.reduceat(level, start)
            live = best < _NONE
            if not live.all():
                stay = np.repeat(live, size)
                done_sym.append(sym[~stay])
                done_seg.append(seg[~stay])
                best, size = best[live], size[live]
                sym, seg, merged, level = sym[stay], seg[stay], merged[stay], level[stay]
                if not len(sym):
                    break
            own = np.repeat(np.arange(len(best)), size)
            at = np.flatnonzero(level == best[own])
            count = np.arange(len(at))
            run = np.maximum.accumulate(np.where(np.append(True, at[1:] != at[:-1] + 1), count, 0))
            first = np.append(True, own[at[1:]] != own[at[:-1]])
            plain = np.ones(len(best), bool)
            plain[own[at[~self._plain[merged[at]]]]] = False
            at = at[first | plain[own[at]] & ((count - run) % 2 == 0)]
            sym[at] = merged[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            level[at] = merged[at] = -1
            sym, seg, merged, level = sym[keep], seg[keep], merged[keep], level[keep]
            now = at - np.arange(len(at))  # one symbol left before each earlier one
            for left in (now - 1, now):
                ok = (left >= 0) & (left + 1 < len(sym))
                left = left[ok]
                same = seg[left] == seg[left + 1]
                level[left[~same]] = _NONE
                left = left[same]
                merged[left], level[left] = self._lookup(sym[left], sym[left + 1])
            level[now[now + 1 >= len(sym)]] = _NONE
        sym, seg = np.concatenate([*done_sym, sym]), np.concatenate([*done_seg, seg])
        order = np.argsort(seg, kind="stable")
        return sym[order], np.bincount(seg, minlength=len(counts))

    def _learn(self, new: list[str]) -> None:
        chars = self._char
        unknown: dict[int, str] = {}

        def symbol(c: str) -> int:
            got = chars.get(c)
            if got is None:
                unknown[-1 - ord(c)] = c
                return -1 - ord(c)
            return got

        points = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, back = np.unique(points, return_inverse=True)
        sym = np.array([symbol(chr(c)) for c in kinds.tolist()], np.int32)[back]
        sym, counts = self._rounds(sym, np.array([len(s) for s in new]))
        if unknown:  # by bytes
            out_of = sym < 0
            raw = {c: self._byte_ids[list(t.encode("utf-8", "surrogatepass"))] for c, t in unknown.items()}
            width = np.ones(len(sym), np.int64)
            width[out_of] = [len(raw[c]) for c in sym[out_of].tolist()]
            owner = np.repeat(np.arange(len(counts)), counts)
            flat = np.repeat(sym, width)
            at = np.concatenate([[0], np.cumsum(width)])[:-1][out_of]
            for i, c in zip(at.tolist(), sym[out_of].tolist(), strict=True):
                flat[i : i + len(raw[c])] = raw[c]
            counts, sym = np.bincount(owner, weights=width, minlength=len(counts)).astype(np.int64), flat
        base = len(self._known)
        self._known.update({s: base + i for i, s in enumerate(new)})
        self._ids = np.concatenate([self._ids, sym.astype(np.int32)])
        self._off = np.concatenate([self._off, self._off[-1] + np.cumsum(counts)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts, each with its begin and end id."""
        split = [_SEGMENT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self._known) > self._cache_size:
            self._reset()
        segments = [s for one in split for s in one]
        known = self._known
        if new := [s for s in set(segments) if s not in known]:
            self._learn(sorted(new))
        which = np.fromiter(map(self._known.__getitem__, segments), np.int64, len(segments))
        size = self._off[which + 1] - self._off[which]
        per_text = np.array([len(one) for one in split], np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        bounds = ends[np.concatenate([[0], np.cumsum(per_text)])]
        flat = self._ids[np.repeat(self._off[which] - ends[:-1], size) + np.arange(ends[-1])]
        offsets = bounds + 2 * np.arange(len(texts) + 1)
        ids = np.empty(offsets[-1], np.int32)
        body = np.ones(len(ids), bool)
        ids[offsets[:-1]], ids[offsets[1:] - 1] = self.bos, self.eos
        body[offsets[:-1]] = body[offsets[1:] - 1] = False
        ids[body] = flat
        return ids, offsets

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The texts, in UTF-8; bytes that are no character become U+FFFD each."""
        size = self._piece_len[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        raw = self._piece_raw[np.repeat(self._piece_off[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        out = []
        for a, b, i, j in zip(ends[offsets[:-1]].tolist(), ends[offsets[1:]].tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            text = raw[a:b]
            try:
                text.decode()
            except UnicodeDecodeError:
                text = self._mended(ids[i:j])
            out.append(text[1:] if text[:1] == b" " and self._leads(ids[i:j]) else text)
        return out

    def _leads(self, ids: np.ndarray) -> bool:
        shown = ids[self._piece_len[ids] > 0]
        return len(shown) > 0 and not self._is_byte[shown[0]]

    def _mended(self, ids: np.ndarray) -> bytes:
        out, run = [], b""
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self._is_byte[i]:
                run += self._bytes[i]
                continue
            while run:
                for width in (1, 2, 3, 4):
                    try:
                        run[:width].decode()
                    except UnicodeDecodeError:
                        continue
                    out.append(run[:width])
                    break
                else:
                    width = 1
                    out.append("�".encode())
                run = run[width:]
            if i >= 0:
                out.append(self._bytes[i])
        return b"".join(out)


def _groups(column: pa.Array, max_chars: int = 400_000) -> Iterator[list[str | None]]:
    held, size = [], 0
    for x in column:
        held.append(t := x.as_py())
        size += len(t or "")
        if size > max_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(documents: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids) of each document, with begin and end ids."""
    model = documents.sparkSession.sparkContext.broadcast(read_model(model_path))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value)
        for batch in batches:
            at = 0
            for texts in _groups(batch.column("text")):
                ids, offsets = codec.encode(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))], ["doc_id", "ids"])
                at += len(texts)

    docs = keyed(documents, "doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text, ids outside the vocabulary an error."""
    model = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value)
        for batch in batches:
            rows = [x or [] for x in batch.column("ids").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
            texts = codec.decode(np.array([i for x in rows for i in x], np.int64), offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.decode() for t in texts], pa.string())], ["doc_id", "text"])

    rows = keyed(encoded, "doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(documents: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, then its ids decoded, in one pass."""
    model = documents.sparkSession.sparkContext.broadcast(read_model(model_path))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value)
        for batch in batches:
            at = 0
            for texts in _groups(batch.column("text")):
                ids, offsets = codec.encode(texts)
                raw = ids.astype("<u4").tobytes()
                bounds = (4 * offsets).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(texts)),
                        pa.array(np.diff(offsets), pa.int64()),
                        pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:], strict=False)], pa.string()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in codec.decode(ids, offsets)], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                at += len(texts)

    docs = keyed(documents, "doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
