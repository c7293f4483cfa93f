"""Many phrases in many texts at once: one automaton over a bounded block of phrases, applied once to each text.

The automaton (Aho and Corasick) reads a text once whatever the number of phrases. The phrases are a stated set, sent in
counted blocks; a text meets as many automata as there are blocks, never the phrases one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases of a block.
BLOCK = 50_000


def _automaton(rows: list[tuple[int, str]]):
    import ahocorasick

    by: dict[str, list[int]] = {}
    for k, phrase in rows:
        by.setdefault(phrase, []).append(k)
    made = ahocorasick.Automaton()
    for phrase, numbers in by.items():
        made.add_word(phrase, (len(phrase), tuple(numbers)))
    made.make_automaton()
    return made


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def found(docs: DataFrame, id: str, text: str, phrases: DataFrame, phrase_id: str, phrase: str, whole_words: bool = False, block: int = BLOCK) -> DataFrame:
    """(phrase_id, id, first, n): the phrases that occur in each text, where first, in characters from 0, and how often,
    overlaps included; with `whole_words` only where no letter, digit or underscore adjoins. Case counts. Null and empty
    texts hold nothing; null and empty phrases are nowhere.
    """
    kinds = [phrases.schema[phrase_id].dataType.simpleString(), docs.schema[id].dataType.simpleString()]
    asked = phrases.filter(F.col(phrase) != "").select(F.col(phrase_id).alias("k"), F.col(phrase).alias("p"))
    blocks = -(-asked.count() // block)
    out = docs.sparkSession.createDataFrame([], f"`{phrase_id}` {kinds[0]}, `{id}` {kinds[1]}, first long, n long")
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("k", "p"), F.lit(blocks)) == b)
        send = docs.sparkSession.sparkContext.broadcast([(r.k, r.p) for r in part.collect()])  # about `block` rows
        cache: list = []

        def run(batches: Iterator[pa.RecordBatch], send=send, cache=cache) -> Iterator[pa.RecordBatch]:
            names = [k for k, _ in send.value]
            if not cache:
                cache.append(_automaton([(n, p) for n, (_, p) in enumerate(send.value)]))
            for batch in batches:
                rows: list[tuple] = []
                for i, t in enumerate(batch.column(text).to_pylist()):
                    if not t or not names:
                        continue
                    met: dict[int, list[int]] = {}
                    for end, (size, numbers) in cache[0].iter(t):
                        at = end - size + 1
                        if whole_words and ((at and _word(t[at - 1]) and _word(t[at])) or (end + 1 < len(t) and _word(t[end + 1]) and _word(t[end]))):
                            continue
                        for n in numbers:
                            met.setdefault(n, [at, 0])[1] += 1
                    rows += [(n, i, at, k) for n, (at, k) in met.items()]
                n, i, at, k = zip(*rows) if rows else ([], [], [], [])
                ids = batch.column(id).take(pa.array(i, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in n], _arrow(kinds[0])), ids, pa.array(at, pa.int64()), pa.array(k, pa.int64())], [phrase_id, id, "first", "n"])

        out = out.union(docs.select(id, text).mapInArrow(run, f"`{phrase_id}` {kinds[0]}, `{id}` {kinds[1]}, first long, n long"))
    return out


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[kind]
