"""Which of many names each of many texts holds: an Aho-Corasick automaton of a block of names, run over batches of texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolode.sources.tables import save

#: Characters of the names of one automaton; a node of it takes about 40 bytes, and there is at most one a character.
BLOCK = 1 << 20


def _automaton(names: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for n in names:
        found.add_word(n, n)
    found.make_automaton()
    return found


def _finder(shared, boundary: str | None):
    """Of batches of (key, text): a row for each name that a text holds, between two of the boundary's characters or the
    text's ends if there is a boundary."""

    def held(text: str) -> set[str]:
        if boundary is None:
            return {name for _, name in shared.value.iter(text)}
        names = set()
        for last, name in shared.value.iter(text):
            before, after = last - len(name), last + 1
            if (before < 0 or text[before] in boundary) and (after == len(text) or text[after] in boundary):
                names.add(name)
        return names

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, names = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                found = held(t) if t else ()
                rows += [k] * len(found)
                names += found
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string())], [b.schema.names[0], "name"])

    return find


def mentions(texts: DataFrame, names: DataFrame, key: str, text: str = "text", name: str = "name", boundary: str | None = None) -> DataFrame:
    """Distinct (key, name) of every name that a text holds: anywhere, inside longer words too, or, if there is a boundary, where
    each side is one of its characters or an end of the text. Names may overlap. Null and empty names and texts hold nothing.

    Names are dealt into blocks of about BLOCK characters; each block is collected, made into one automaton and broadcast, and
    the texts are read once a block, so that a text's cost is its length and its finds.
    """
    spark = texts.sparkSession
    known = save(names.select(F.col(name).cast("string").alias("name")).where("name <> ''").distinct(), "names")
    size = known.agg(F.sum(F.length("name"))).first()[0] or 0
    blocks = -(-size // BLOCK)
    rows, kind = texts.select(key, F.col(text).cast("string").alias("text")).where("text <> ''"), texts.schema[key].dataType.simpleString()
    found = []
    for block in range(blocks):
        mine = known.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == block).toArrow()["name"].to_pylist()
        if mine:
            shared = spark.sparkContext.broadcast(_automaton(mine))
            found.append(rows.mapInArrow(_finder(shared, boundary), f"`{key}` {kind}, name string"))
    none = texts.select(key, F.lit(None).cast("string").alias("name")).limit(0)
    return reduce(DataFrame.unionByName, found).distinct() if found else none
