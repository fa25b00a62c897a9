"""Dictionary search: all words of a dictionary in one pass over each text, by an Aho-Corasick automaton."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARS = 4_000_000  # characters of the words of one automaton, which is broadcast


def built(words: Sequence[str]) -> bytes:
    """A pickled automaton of ``words`` that gives their numbers."""
    found = ahocorasick.Automaton()
    for k, word in enumerate(words):
        found.add_word(word, k)
    if len(found):
        found.make_automaton()
    return pickle.dumps(found)


def with_hits(rows: DataFrame, text: Column, words: Sequence[str], name: str = "hits") -> DataFrame:
    """``rows`` with the sorted numbers of the ``words`` (distinct, not empty) that ``text`` contains; a null text contains none.

    The time for a text follows its length and its hits, not the number of words.
    """
    held = rows.sparkSession.sparkContext.broadcast(built(words))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = pickle.loads(held.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            hits = [sorted({k for _, k in automaton.iter(t)}) if t and len(automaton) else [] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hits, pa.list_(pa.int32()))], [*batch.schema.names[:-1], name])

    return rows.select("*", text.alias("_text")).mapInArrow(work, f"{fields}, `{name}` array<int>")


def count_hits(hits: Column, words: Sequence[str], group: Sequence[str]) -> Column:
    """How many entries of ``group`` are among the hits; a word that it lists twice counts twice."""
    place = {w: k for k, w in enumerate(words)}
    own = [place[w] for w in group]
    return F.size(F.filter(F.array(*(F.lit(k) for k in own)), lambda k: F.array_contains(hits, k)))


def hit_terms(rows: DataFrame, text: Column, terms: DataFrame, key: str) -> DataFrame:
    """``key, term``: the terms of a table (``term``) that each row's text contains.

    The terms go to the tasks in automata of at most about ``CHARS`` characters, so a larger dictionary is more passes over the
    texts, and no substring of a text is ever made.
    """
    spark, words = rows.sparkSession, terms.select("term").where("term <> ''").distinct()
    size = words.agg(F.sum(F.char_length("term"))).first()[0] or 0
    parts = max(1, -(-2 * size // CHARS))
    out = None
    for part in range(parts):
        own = [r[0] for r in words.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == part).orderBy("term").collect()]  # at most about CHARS characters
        listed = spark.createDataFrame(list(enumerate(own)), "_at int, term string")
        found = with_hits(rows.select(F.col(key).alias("_key"), text.alias("_t")), F.col("_t"), own, "_hits").select(F.col("_key").alias(key), F.explode("_hits").alias("_at"))
        found = found.join(listed, "_at").select(key, "term")
        out = found if out is None else out.unionByName(found)
    return out
