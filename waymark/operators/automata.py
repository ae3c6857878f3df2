"""Many strings looked for in texts at once, by automata."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.sources.staged import written

#: Characters of all the strings of one automaton; a state is held for each at most, some 50 MB.
MACHINE_CHARS = 1 << 20
#: The automaton that a worker built last, by its number.
_BUILT: dict[str, object] = {}


def _machine(number: str, words: list[str]):
    """An Aho-Corasick automaton; one for all tasks of a Python worker that use it."""
    import ahocorasick

    if number not in _BUILT:
        made = ahocorasick.Automaton()
        for i, w in enumerate(words):
            made.add_word(w, i)
        made.make_automaton()
        _BUILT.clear()
        _BUILT[number] = made
    return _BUILT[number]


def _scan(number: str, shared):
    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        machine = _machine(number, words)
        for batch in it:
            rows, paragraphs, found = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                first, at, paragraph = {}, 0, 0
                for end, word in machine.iter(text or "") if words else ():
                    paragraph += text.count("\n", at, end)
                    at = end
                    if word not in first:
                        first[word] = paragraph
                rows += [row] * len(first)
                paragraphs += first.values()
                found += [words[w] for w in first]
            kept = [batch.column(c).take(pa.array(rows, pa.int32())) for c in batch.schema.names if c != "text"]
            names = [*(c for c in batch.schema.names if c != "text"), "alias", "paragraph"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.string()), pa.array(paragraphs, pa.int32())], names=names)

    return scan


def mentions(texts: DataFrame, words: DataFrame) -> DataFrame:
    """For each row of texts (text and other columns, which stay) and each distinct string of words (alias) that its text contains: the number
    from 0 of the first line that holds it. Strings that hold a line break are in no line; empty ones are left out, and a null
    text holds nothing.

    The strings are dealt to automata of MACHINE_CHARS characters at most; each is built once in a worker and reads a text in one
    pass, however many strings it has. With more strings than one automaton may hold the texts are read once for each."""
    spark = texts.sparkSession
    distinct = words.select("alias").filter("alias <> '' and not contains(alias, '\\n')").distinct()
    chars = distinct.agg(F.sum(F.length("alias"))).first()[0] or 0
    # twice as many as the mean asks for, so that a group over its bound is out of the question for strings of usual length
    machines = 1 if chars <= MACHINE_CHARS else -(-2 * chars // MACHINE_CHARS)
    grouped = distinct.withColumn("machine", F.pmod(F.xxhash64("alias"), F.lit(machines)))
    if machines > 1:
        grouped = written(grouped, "aliases")
    columns = [f for f in texts.schema if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in columns), "alias string, paragraph int"])
    found = []
    for m in range(machines):
        held = spark.sparkContext.broadcast(sorted(r["alias"] for r in grouped.filter(F.col("machine") == m).select("alias").collect()))
        found.append(texts.mapInArrow(_scan(uuid.uuid4().hex, held), schema))
    return reduce(DataFrame.union, found)
