"""Patterns told by Arrow's matcher, and many terms in one pass over a text: an Aho-Corasick automaton of all of them.

The automaton goes to the tasks as a list of terms of bounded size; a longer list is dealt into shards, one pass each.
Needs the pyahocorasick library on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")
Term = tuple[str, bool, object]  # term, only as a whole word, value


class Automaton:
    """Terms of a text with their values; whole words are bounded by characters that aren't in `word`."""

    def __init__(self, terms: list[Term], word: frozenset[str] = WORD):
        import ahocorasick

        self._word, self._found = word, ahocorasick.Automaton()
        held: dict[str, list] = {}
        for term, whole, value in terms:
            if term:
                held.setdefault(term, []).append((whole, value))
        for term, values in held.items():
            self._found.add_word(term, (len(term), values))
        if held:
            self._found.make_automaton()
        self._any = bool(held)

    def values(self, text: str) -> Iterator[object]:
        """The value of each occurrence of each term, in order of their ends."""
        if not self._any:
            return
        word, last = self._word, len(text) - 1
        for end, (size, values) in self._found.iter(text):
            start = end - size + 1
            apart = not (start > 0 and text[start - 1] in word or end < last and text[end + 1] in word)
            for whole, value in values:
                if apart or not whole:
                    yield value


def holds(text: Column, pattern: str) -> Column:
    """Whether a text holds the pattern, in time linear in the text however many alternatives there are; null for null.

    Arrow's matcher walks a text once; the JVM's tries each alternative at each character.
    """

    def told(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, pattern)

    return F.arrow_udf(told, "boolean")(text)


def shards(terms: DataFrame, most_bytes: int = 16 << 20) -> Iterator[list]:
    """The rows of a list of terms (a column `term` and others) in lists of about that many bytes."""
    total = terms.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    n = max(1, -(-total // most_bytes))
    for i in range(n):
        yield terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == i).collect()


def matched(lines: DataFrame, text: str, terms: list[Term], out: str, kind: DataType, told: Callable[[Iterator[object]], object], word: frozenset[str] = WORD) -> DataFrame:
    """lines with a column `out` of that type: told(values of the terms that the text holds). A null text holds none."""
    schema = StructType(list(lines.schema.fields)).add(out, kind)
    made, shared = to_arrow_type(kind), lines.sparkSession.sparkContext.broadcast((terms, word))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(*shared.value)
        for batch in batches:
            got = [told(automaton.values(t or "")) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, made)], [*batch.schema.names, out])

    return lines.mapInArrow(run, schema)
