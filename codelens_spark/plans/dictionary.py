"""Finding the words of a dictionary in texts, in one pass over the texts.

The words are matched by one automaton (Aho-Corasick), so the cost of a text is its length plus its matches, whatever
the number and kind of the words. A dictionary within WORDS and WORD_BYTES goes to the tasks as it is; a larger one is
cut into blocks of that size by hash, and each block is sought in a pass of its own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import stage

WORDS, WORD_BYTES = 250_000, 16 << 20
HITS = 1 << 16  # rows of a result batch, about

Entries = tuple[tuple[str, tuple[str | None, ...] | None], ...]


@functools.lru_cache(maxsize=1)
def _automaton(entries: Entries) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for n, (word, _) in enumerate(entries):
        found.add_word(word, n)
    found.make_automaton()
    return found


def _seek(entries: Entries):
    keys = [None if k is None else frozenset(k) for _, k in entries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(entries)
        for batch in batches:
            texts, own = batch.column(0), batch.column(1)
            rest = batch.select(batch.schema.names[1:])  # a hit carries no copy of its text
            rows, words = [], []
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                if text:
                    hits = {n for _, n in automaton.iter(text)}
                    if keys and keys[0] is not None and hits:
                        key = own[k].as_py()
                        hits = {n for n in hits if key in keys[n]}
                    rows += [k] * len(hits)
                    words += [entries[n][0] for n in hits]
                if len(rows) > HITS or (rows and k + 1 == batch.num_rows):
                    yield pa.RecordBatch.from_arrays([*rest.take(pa.array(rows)).columns, pa.array(words, pa.string())], names=[*rest.schema.names, "word"])
                    rows, words = [], []

    return run


def find_words(words: DataFrame, texts: DataFrame, keyed: bool = False) -> DataFrame:
    """(key?, text_id, word), once per row of `texts`(key?, text_id, text) and word that it contains.

    words(key?, word): with `keyed` a word is sought only in texts of its key. Null and empty words match nothing, nor
    do null texts or keys.
    """
    key = ["key"] if keyed else []
    own = F.col("key").cast("string") if keyed else F.lit(None).cast("string")
    known = words.filter("word is not null and word <> ''").select(own.alias("key"), "word").distinct()
    known = stage(known.filter("key is not null") if keyed else known, "dictionary")
    rows, size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word") + F.coalesce(F.octet_length("key"), F.lit(0))), F.lit(0))).first()
    blocks = max(1, -(-rows // WORDS), -(-size // WORD_BYTES))
    source = texts.select("text", own.alias("__key"), *key, "text_id")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[1:]) + ", word string"
    found = []
    for block in range(blocks):
        part = known.filter(F.pmod(F.xxhash64("word"), F.lit(blocks)) == block).groupBy("word").agg(F.array_sort(F.collect_set("key")).alias("keys"))
        entries = tuple((r["word"], tuple(r["keys"]) if keyed else None) for r in part.orderBy("word").collect())
        if entries:
            found.append(source.mapInArrow(_seek(entries), schema).drop("__key"))
    return reduce(DataFrame.unionByName, found) if found else texts.select(*key, "text_id", F.lit("").alias("word")).limit(0)
