"""Language ID by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is parsed against it into phrases, each the
longest string from where the last one ended that occurs in that language's text; the language that needs the fewest
phrases, normalised by the text's length, wins. The automaton's transitions lie in a double array (rows of all states laid
into one another), some eight bytes each, so a parse is one look-up a character, done for many texts at once. Texts are parsed in pieces of PIECE characters,
all of them; a piece boundary ends a phrase in every language alike.

Training reads at most `rows_per_language` labelled texts of each language (by a hash of their id), of a text longer
than `window` characters a window from its middle, and of these as many as fit in `chars_per_language` characters.
Character classes: the `alphabet` most frequent letters, after lower-casing, of each language's own training text;
other letters are dealt by code point into OTHERS classes; runs of anything else are one space.

Edge cases: a null text, or one without a letter, is 'und' with score 0; equal counts go to the first language in
order; without training rows all texts are 'und'; rows with a null id go, of rows that repeat an id the least stays.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import keyed, lean

PIECE = 2048
OTHERS = 16
TOGETHER = 8  # languages parsed at once


class SuffixAutomaton:
    """States and transitions of all substrings of a sequence of small integers.

    A state's transition by symbol c lies at base[state] + c, if owner there is the state.
    """

    def __init__(self, symbols: list[int], n_symbols: int):
        steps: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in symbols:
            new = len(steps)
            steps.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in steps[p]:
                steps[p][c] = new
                p = link[p]
            if p >= 0:
                q = steps[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(steps)
                    steps.append(dict(steps[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and steps[p].get(c) == q:
                        steps[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self._lay(steps, n_symbols)

    def _lay(self, steps: list[dict[int, int]], width: int) -> None:
        """First fit: states of many transitions first, those of one fill what is left."""
        total = sum(map(len, steps))
        used = np.zeros(2 * total + 4 * width + 64, bool)
        used[:width] = True  # below, so that base + symbol is never negative
        self.base = np.zeros(len(steps), np.int32)
        low = width
        for s in sorted((s for s, row in enumerate(steps) if len(row) > 1), key=lambda s: (-len(steps[s]), s)):
            own = np.array(sorted(steps[s]))
            at, span = low, 64
            while True:
                if at + span + 2 * width > len(used):
                    used = np.concatenate([used, np.zeros(len(used) + span + 2 * width, bool)])
                free = np.flatnonzero(~used[at : at + span]) + at
                fits = free[~used[(free - own[0])[:, None] + own].any(1)] if len(free) else free
                if len(fits):
                    break
                at, span = at + span, 2 * span
            self.base[s] = fits[0] - own[0]
            used[self.base[s] + own] = True
            low = max(low, at - 256)  # holes further down are left to states of one transition
            while used[low]:
                low += 1
        single = [s for s, row in enumerate(steps) if len(row) == 1]
        free = np.flatnonzero(~used)[: len(single)]
        free = np.concatenate([free, len(used) + np.arange(len(single) - len(free))])
        self.base[single] = free - [next(iter(steps[s])) for s in single]
        state = np.repeat(np.arange(len(steps), dtype=np.int32), [len(row) for row in steps])
        at = self.base[state] + np.fromiter((c for row in steps for c in row), np.int32, total)
        self.owner = np.full(int(at.max(initial=0)) + 2 * width + 1, -1, np.int32)
        self.target = np.full(len(self.owner), -1, np.int32)
        self.owner[at], self.target[at] = state, np.fromiter((t for row in steps for t in row.values()), np.int32, total)
        self.root = self.step(np.zeros(width, np.int32), np.arange(width))

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The state after each symbol, -1 for none."""
        at = self.base[state] + symbol
        return np.where(self.owner[at] == state, self.target[at], -1)


class Joined:
    """Some languages' automata side by side: one look-up takes a step in all of them."""

    def __init__(self, automata: list[SuffixAutomaton], tables: list[np.ndarray]):
        states, slots = (np.concatenate([[0], np.cumsum([len(x) for x in own])]) for own in ([a.base for a in automata], [a.owner for a in automata]))
        self.base = np.concatenate([a.base + k for a, k in zip(automata, slots.tolist(), strict=False)]).astype(np.int32)
        moved = lambda of: np.concatenate([np.where(x < 0, x, x + k) for x, k in zip(of, states.tolist(), strict=False)]).astype(np.int32)
        self.owner, self.target = moved([a.owner for a in automata]), moved([a.target for a in automata])
        width = max(len(a.root) for a in automata)
        self.unknown = np.concatenate([np.append(a.root < 0, np.ones(width - len(a.root), bool)) for a in automata])  # such a symbol is a phrase by itself
        self.root = np.concatenate([np.append(np.maximum(a.root, 0), np.zeros(width - len(a.root), np.int32)) + k for a, k in zip(automata, states.tolist(), strict=False)]).astype(np.int32)
        self.first = (width * np.arange(len(automata))).astype(np.int32)
        self.tables = np.stack(tables, 1)  # a code point's symbol in each language

    def phrases(self, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(pieces, languages): phrases that each piece points[start : start + size] is parsed into."""
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        symbols = self.tables[points]
        shape = (len(size), len(self.first))
        state, count = np.zeros(shape, np.int32), np.zeros(shape, np.int32)
        ended = np.ones(shape, bool)
        longest = int(size[0]) if len(size) else 0
        for k, live in enumerate(np.searchsorted(-size, -np.arange(1, longest + 1), "right").tolist()):
            c = symbols[start[:live] + k]
            own = state[:live]
            at = self.base[own] + c
            to = self.target[at]
            lost = self.owner[at] != own
            new = ended[:live] | lost
            count[:live] += new
            c = c + self.first
            state[:live] = np.where(new, self.root[c], to)
            ended[:live] = self.unknown[c]
        out = np.empty(shape, np.int64)
        out[order] = count
        return out


class Model:
    """Automata of all languages, each over its own alphabet."""

    def __init__(self, texts: dict[str, list[str]], chars: int, alphabet: int = 60):
        self.points: dict[str, np.ndarray] = {}
        self.automata: dict[str, SuffixAutomaton] = {}
        for lang, own in sorted(texts.items()):
            text = self._whole(own, chars)
            often = Counter(c for c in text if c.isalpha())
            kinds = sorted(c for c, _ in sorted(often.items(), key=lambda x: (-x[1], x[0]))[:alphabet])
            if text:
                self.points[lang] = np.array([ord(c) for c in kinds], np.uint32)
                points = self._run_free(text)
                self.automata[lang] = SuffixAutomaton(self.table(lang)[points].tolist(), len(kinds) + OTHERS + 1)

    @staticmethod
    def _whole(own: list[str], chars: int) -> str:
        out, size = [], 0
        for t in own:
            if size and size + len(t) > chars:
                continue
            out.append(t.lower())
            size += len(t)
        return "\n".join(out)

    def table(self, lang: str) -> np.ndarray:
        """Class, in one language's alphabet, of each code point."""
        kinds, points = self.points[lang], np.arange(0x110000, dtype=np.uint32)
        out = (len(kinds) + 1 + points % OTHERS).astype(np.int16)
        out[kinds] = np.arange(len(kinds))
        return np.where(self._letters(), out, len(kinds)).astype(np.int16)

    def joined(self) -> list[Joined]:
        """The automata, TOGETHER at a time, made where they are first used."""
        if not hasattr(self, "_joined"):
            names = list(self.automata)
            self._joined = [Joined([self.automata[k] for k in own], [self.table(k) for k in own]) for own in (names[i : i + TOGETHER] for i in range(0, len(names), TOGETHER))]
        return self._joined

    def _run_free(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self._letters()[np.minimum(points, 0x10FFFF)]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        return points[keep]

    @staticmethod
    def _letters() -> np.ndarray:
        global _LETTERS
        if _LETTERS is None:
            _LETTERS = np.array([chr(i).isalpha() for i in range(0x110000)])
        return _LETTERS

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """(language, score, normalised phrases a character) of each text."""
        low = [(t or "").lower() for t in texts]
        size = np.array([len(t) for t in low], np.int64)
        points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = self._letters()[np.minimum(points, 0x10FFFF)]
        ends = np.cumsum(size)
        keep = letters.copy()
        keep[1:] |= letters[:-1]  # the first of each run of others
        kept = np.concatenate([[0], np.cumsum(keep)])
        size = kept[ends] - kept[ends - size]
        points, letters, ends = points[keep], letters[keep], np.cumsum(size)
        has = np.concatenate([[0], np.cumsum(letters)])
        lettered = has[ends] - has[ends - size] > 0
        pieces = -(-size // PIECE)
        owner = np.repeat(np.arange(len(low)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = (ends - size)[owner] + nth * PIECE
        width = np.minimum(PIECE, size[owner] - nth * PIECE)
        names = list(self.automata)
        if not names:
            return ["und"] * len(low), [0.0] * len(low), [0.0] * len(low)
        each = np.concatenate([some.phrases(points, start, width) for some in self.joined()], 1)
        sums = np.concatenate([np.zeros((1, len(names)), np.int64), np.cumsum(each, 0)])  # pieces stand in order of their texts
        last = np.cumsum(pieces)
        need = (sums[last] - sums[last - pieces]).astype(float)
        # h = phrases * log2(n) / n bits a character, a cross-entropy estimate
        bits = need * np.log2(np.maximum(size, 2))[:, None] / np.maximum(size, 1)[:, None]
        best = bits.argmin(1)
        weight = np.exp2(-np.minimum((bits - bits.min(1)[:, None]) * np.minimum(size, 400)[:, None] / 8, 500))
        score = 1 / weight.sum(1)
        lang = [names[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        return lang, np.where(lettered, score, 0.0).tolist(), (need.min(1) / np.maximum(size, 1)).tolist()


_LETTERS = None


def train(labelled: DataFrame, rows_per_language: int = 400, chars_per_language: int = 60_000, window: int = 4000, alphabet: int = 60) -> Model:
    """Fit on (doc_id, text, lang) rows with neither null: a bounded sample by hash, collected and fitted here."""
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    light = rows.where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id"))
    # Hash ranges thin the rows before the window, so that no language's rows meet in one task.
    counts = {r.lang: r.n for r in light.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model({}, chars_per_language, alphabet)
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1 << 20, 4 * rows_per_language * (1 << 20) // max(1, n)))) for k, n in counts.items()])
    chosen = light.where(slot <= share).select("doc_id", "lang", nth.alias("k")).where(F.col("k") <= rows_per_language).select("doc_id")
    middle = F.substring("text", F.greatest(F.lit(1), F.floor((F.length("text") - window) / 2).cast("int") + 1), F.lit(window))
    got = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", middle.alias("text"), "lang").collect()  # at most rows_per_language texts of `window` characters a language
    texts: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: str(r.doc_id)):
        texts.setdefault(r.lang, []).append(r.text)
    return Model(texts, chars_per_language, alphabet)


def held_out() -> F.Column:
    """Whether crc32 of the id as text leaves 1 by 3."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def identify(documents: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, phrase_rate) of each document, from its text alone, and the columns to carry along."""
    docs = keyed(documents, "doc_id", *dict.fromkeys(("text", *carry)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            at = 0
            while at < len(batch):
                held, size = [], 0
                while at + len(held) < len(batch) and size < 1_000_000:
                    held.append(texts[at + len(held)].as_py())
                    size += len(held[-1] or "")
                lang, score, rate = shared.value.predict(held)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(held)), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64()), *(batch.column(k).slice(at, len(held)) for k in own)], ["doc_id", "lang_pred", "score", "phrase_rate", *own])
                at += len(held)

    own = [c for c in docs.columns if c in carry]
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in own)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, phrase_rate double{more}")


def language_id(documents: DataFrame, rows_per_language: int = 400, chars_per_language: int = 60_000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each document, trained on the rows that are not held out."""
    docs = keyed(documents, "doc_id", "text", "lang")
    model = train(docs.where(~held_out()), rows_per_language, chars_per_language)
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "phrase_rate")
