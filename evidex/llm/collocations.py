"""Phrase collocation mining with weighted acyclic automata.

The counts of a language's n-grams (up to three words) form a transducer: from the root an arc a first word, from there an
arc a second, then a third, and each arc carries how often the n-gram that ends with it occurs. Equal n-grams share their
path, so an automaton has an arc a distinct n-gram.

1. Words are counted, block by block, to know the languages' sizes and the hot words.
2. Each task numbers the words of a block in byte order, sorts the block's n-grams once and builds the transducer level by
   level from the sorted sequence. It is cut by prefix: what follows one first word is a row, or several for a hot word,
   whose second words are dealt to slots by hash. So no prefix holds more n-grams than a bounded number of occurrences,
   and a block has a row a distinct word, not a row an n-gram.
3. Rows of one prefix meet in one task, sorted, and are united level by level, weights of equal arcs added. Those are all
   occurrences, so arcs below the least count go for good: no n-gram is as frequent as its parts are rare.
4. Phrases and cuts are read off the united automata. The first part of a cut lies on the phrase's own path. The rest
   begins with another word: it is sent to that word's prefix and composed with the automaton there, arc by arc. Counts of
   hot words need no sending, every task has them.

Scores and choices are exact integers in DataFrame functions.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import raw, slices, staged

#: Occurrences of a candidate, phrases a language, and the share in percent from which a longer candidate replaces its part.
LEAST, TOP, COVERED = 10, 2000, 50
#: Words of a block, different words that fill one before that (below 2^21), and occurrences a shard of prefixes.
BLOCK_WORDS, BLOCK_NAMES, SHARD_WORDS = 3_000_000, 1_500_000, 4_000_000
#: A word of more occurrences is hot. There are `HOT_WORDS` of them at most: in larger inputs the bound rises.
HOT, HOT_WORDS = 500_000, 1_000_000
#: Arcs that a task unites at a time.
UNION_ARCS = 1 << 20
_STOP = b"\xff"  # no UTF-8 text holds it
_BLANK = bytes(0xFF if chr(c) in ".,;:!?\n\v\f\r" else 0x20 if c == 9 else c for c in range(256))


def tokens_of(text: bytes, part: int = 4 << 20) -> Iterator[list[bytes]]:
    """A-Z lower-cased words and, between pieces, the stop; in lists from about `part` bytes each."""
    text = text.lower().translate(_BLANK)
    at = 0
    while at < len(text):
        cut = text.find(b" ", at + part)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut].replace(_STOP, b" \xff ").split()
        at = cut


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for rows in slices(batch, "text"):
            yield from zip(rows.column("lang").to_pylist(), raw(rows, "text"))


def word_counts(texts: DataFrame, names: int = BLOCK_NAMES) -> DataFrame:
    """(lang, word, n) of all words. `texts`: lang without nulls, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def out():
            for lang, c in counts.items():
                c.pop(_STOP, None)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array([*c], pa.binary()).cast(pa.string()), pa.array([*c.values()], pa.int64())], ["lang", "word", "n"])
            counts.clear()

        for lang, text in _rows(batches):
            mine = counts.setdefault(lang, Counter())
            for tokens in tokens_of(text):
                mine.update(tokens)
            if sum(map(len, counts.values())) >= names:
                yield from out()
        yield from out()

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class _Ids(dict):
    """Numbers of words in order of appearance; the stop is 0."""

    def __init__(self):
        super().__init__({_STOP: 0})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Transducer:
    """Arcs by level: `w1` with counts `n1`; arc i leads to the arcs first2[i] to first2[i + 1] of `w2` and `n2`, and those
    to `w3` and `n3` alike. Words are numbers; numbers ascend within a state."""

    def __init__(self, words):
        """From a sequence of word numbers from 1 on, in byte order of the words, below 2^21; 0 parts pieces."""
        import numpy as np

        words = words.astype(np.int64)
        one = words[words > 0]
        two = words[:-1] << 21 | words[1:]
        two = two[(words[:-1] > 0) & (words[1:] > 0)]
        both = (words[:-2] > 0) & (words[1:-1] > 0) & (words[2:] > 0)
        three = (words[:-2][both] << 42) | (words[1:-1][both] << 21) | words[2:][both]
        levels = []
        for grams in (one, two, three):
            grams = np.sort(grams)
            new = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
            levels.append((grams[new], np.diff(np.r_[new, len(grams)])))
        (k1, self.n1), (k2, self.n2), (k3, self.n3) = levels
        self.w1, self.w2, self.w3 = k1, k2 & (1 << 21) - 1, k3 & (1 << 21) - 1
        self.first2 = np.r_[np.searchsorted(k2 >> 21, k1), len(k2)]
        self.first3 = np.r_[np.searchsorted(k3 >> 21, k2), len(k3)]


def slot_of(word: bytes, n_slots: int) -> int:
    return zlib.crc32(word) % n_slots


#: A prefix's row: its word's count, the second words and their counts, how many third words each has, those and theirs.
#: A blank follows each word; numbers are packed, counts in 8 bytes, numbers of arcs in 4.
PREFIX = "lang string, word string, slot int, n1 long, w2 binary, n2 binary, k3 binary, w3 binary, n3 binary"
FIELDS = ["lang", "word", "slot", "n1", "w2", "n2", "k3", "w3", "n3"]


def _packed(data, ends) -> pa.Array:
    """A binary column: `data` cut at `ends`, which begin with 0."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype("int32")), pa.py_buffer(data)])


def _payload(column: pa.Array):
    """The bytes of a binary column one after the other, and each row's number of bytes."""
    import numpy as np

    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (memoryview(data)[ends[0] : ends[-1]] if data else b""), np.diff(ends)


def _rows_of(heads: list[pa.Array], n1, bounds, w2, n2, k3, w3, n3, names: list[bytes]) -> pa.RecordBatch:
    """Prefix rows from arcs in order: row r has the second words bounds[r] to bounds[r + 1]. Words are places in `names`."""
    import numpy as np

    spaced = pa.array([n + b" " for n in names], pa.binary())

    def text(words):
        taken = spaced.take(pa.array(words))
        return taken.buffers()[2] or b"", np.frombuffer(taken.buffers()[1], np.int32)[: len(words) + 1]

    (text2, ends2), (text3, ends3), first3 = text(w2), text(w3), np.r_[0, np.cumsum(k3)]
    columns = [_packed(text2, ends2[bounds]), _packed(n2.astype("<i8").tobytes(), bounds * 8), _packed(k3.astype("<u4").tobytes(), bounds * 4), _packed(text3, ends3[first3[bounds]]), _packed(n3.astype("<i8").tobytes(), first3[bounds] * 8)]
    return pa.RecordBatch.from_arrays([*heads, pa.array(n1, pa.int64()), *columns], FIELDS)


def prefixes(t: Transducer, lang: str, names: list[bytes], slots: dict[tuple[str, bytes], int]) -> pa.RecordBatch:
    """Rows of a block's transducer, a row a first word and slot."""
    import numpy as np

    word = np.repeat(np.arange(len(t.w1)), np.diff(t.first2))
    slot = np.zeros(len(t.w2), np.int64)
    for i in [i for i, w in enumerate(t.w1.tolist()) if (lang, names[w]) in slots] if slots else ():
        n = slots[lang, names[t.w1[i]]]
        slot[t.first2[i] : t.first2[i + 1]] = [slot_of(names[x], n) for x in t.w2[t.first2[i] : t.first2[i + 1]].tolist()]
    key = word << 32 | slot
    order, k3 = np.argsort(key, kind="stable"), np.diff(t.first3)
    third = np.repeat(t.first3[:-1][order] - np.r_[0, np.cumsum(k3[order])[:-1]], k3[order]) + np.arange(len(t.w3)) if len(order) else np.zeros(0, np.int64)
    key = key[order]
    rows = np.union1d(key, np.setdiff1d(np.arange(len(t.w1)), word) << 32)
    at, words = rows >> 32, pa.array(names, pa.binary()).cast(pa.string())
    heads = [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(rows), np.int64))), words.take(pa.array(t.w1[at])), pa.array((rows & (1 << 32) - 1).astype(np.int32))]
    return _rows_of(heads, t.n1[at], np.r_[np.searchsorted(key, rows), len(key)], t.w2[order], t.n2[order], k3[order], t.w3[third], t.n3[third], names)


def _blocks(texts: DataFrame, slots, block_words: int, block_names: int) -> DataFrame:
    """Prefix rows of every block. `slots`: a broadcast dictionary of the hot words' slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        ids, parts, size = _Ids(), {}, 0

        def out():
            order = sorted(w for w in ids if w != _STOP)
            rank = np.zeros(len(ids), np.int64)
            rank[[ids[w] for w in order]] = np.arange(1, len(order) + 1)
            for lang in sorted(parts):
                yield prefixes(Transducer(rank[np.concatenate(parts[lang])]), lang, [b"", *order], slots.value)

        for lang, text in _rows(batches):
            mine = parts.setdefault(lang, [])
            for tokens in tokens_of(text):
                mine.append(np.fromiter(map(ids.__getitem__, tokens), np.int32, len(tokens)))
                size += len(tokens)
            mine.append(np.zeros(1, np.int32))
            if size >= block_words or len(ids) > block_names:
                yield from out()
                ids, parts, size = _Ids(), {}, 0
        yield from out()

    return texts.mapInArrow(run, PREFIX)


def _new_prefix(rows: pa.RecordBatch):
    """Which rows begin a prefix."""
    import numpy as np
    import pyarrow.compute as pc

    n = rows.num_rows
    new = np.ones(n, bool)
    if n > 1:
        differ = [pc.not_equal(c[: n - 1], c[1:]).to_numpy(zero_copy_only=False) for c in rows.columns[:3]]
        new[1:] = differ[0] | differ[1] | differ[2]
    return new


def union(rows: pa.RecordBatch, least: int) -> pa.RecordBatch:
    """United prefix rows: rows of equal (lang, word, slot) follow each other and become one, the weights of equal arcs added
    level by level; arcs below `least` go, and rows whose word is below it."""
    import numpy as np

    ids = _Ids()
    new = _new_prefix(rows)
    key = np.cumsum(new) - 1
    n_keys = int(new.sum())
    data = {c: _payload(rows.column(c)) for c in FIELDS[4:]}

    def words(c: str):
        found = bytes(data[c][0])[:-1].split(b" ") if len(data[c][0]) else []
        return np.fromiter(map(ids.__getitem__, found), np.int64, len(found))

    def added(state, word, n):
        """Arcs (state, word) with their sums, and which arc each of the given ones became."""
        arcs, became = np.unique(state << 32 | word, return_inverse=True)
        total = np.zeros(len(arcs), np.int64)
        np.add.at(total, became, n)
        return arcs, total, became

    n1 = np.zeros(n_keys, np.int64)
    np.add.at(n1, key, rows.column("n1").to_numpy())
    arcs2, sum2, became2 = added(np.repeat(key, data["n2"][1] // 8), words("w2"), np.frombuffer(data["n2"][0], "<i8"))
    arcs3, sum3, _ = added(np.repeat(became2, np.frombuffer(data["k3"][0], "<u4")), words("w3"), np.frombuffer(data["n3"][0], "<i8"))
    keep = sum3 >= least
    arcs3, sum3 = arcs3[keep], sum3[keep]
    per2 = np.bincount(arcs3 >> 32, minlength=len(arcs2)) if len(arcs2) else np.zeros(0, np.int64)
    keep = sum2 >= least
    arcs2, sum2, per2 = arcs2[keep], sum2[keep], per2[keep]  # no arc that goes has a third word that stays
    stay = np.flatnonzero(n1 >= least)  # nor a word that goes a second
    heads = [c.take(pa.array(np.flatnonzero(new)[stay])) for c in rows.columns[:3]]
    low = (1 << 32) - 1
    return _rows_of(heads, n1[stay], np.r_[np.searchsorted(arcs2 >> 32, stay), len(arcs2)], arcs2 & low, sum2, per2, arcs3 & low, sum3, [*ids])


def _united(blocks: DataFrame, shards: int, least: int, arcs: int) -> DataFrame:
    """One row a prefix, with all occurrences' counts of at least `least`."""

    def size_of(rows: pa.RecordBatch) -> int:
        return rows.num_rows + (len(_payload(rows.column("n2"))[0]) + len(_payload(rows.column("n3"))[0])) // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += size_of(batch)
            if size < arcs:
                continue
            rows = pa.concat_batches(held)
            last = int(np.flatnonzero(_new_prefix(rows))[-1])
            if last:
                yield union(rows.slice(0, last), least)
                held = [rows.slice(last)]
                size = size_of(held[0])
            elif size >= 2 * arcs:  # one prefix of many arcs: what is here becomes one row, united again after as many more
                held, size = [union(rows, 0)], 0
        if held:
            yield union(pa.concat_batches(held), least)

    return blocks.repartition(shards, "lang", "word", "slot").sortWithinPartitions("lang", "word", "slot").mapInArrow(run, PREFIX)


def _grams(row: tuple) -> Iterator[tuple[bytes, int, list[tuple[bytes, int]]]]:
    """The second words of a prefix row: word, count, third words with their counts."""
    import numpy as np

    if not row[4]:
        return
    third = iter(zip(row[7][:-1].split(b" ") if row[7] else [], np.frombuffer(row[8], "<i8").tolist()))
    for w, n, k in zip(row[4][:-1].split(b" "), np.frombuffer(row[5], "<i8").tolist(), np.frombuffer(row[6], "<u4").tolist()):
        yield w, n, [next(third) for _ in range(k)]


CUT = ["lang", "word", "slot", "phrase", "a", "k", "l", "rest", "r"]


def _cuts(united: DataFrame, hot) -> DataFrame:
    """(lang, word, slot, phrase, a, k, l, rest, r): every phrase of two or three words and every cut, after k words, with the
    prefix to which the rest belongs. `r` is known where the rest is a hot word. `hot`: broadcast, the hot words' counts and slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, slots = hot.value
        for batch in batches:
            out = []
            for row in zip(*(c.cast(pa.binary()).to_pylist() if n == "word" else c.to_pylist() for n, c in zip(FIELDS, batch.columns))):
                lang, one = row[:2]
                l1 = counts.get((lang, one), row[3])
                for two, n, more in _grams(row):
                    out.append((lang, two, 0, one + b" " + two, n, 1, l1, two, counts.get((lang, two))))
                    n_slots = slots.get((lang, two))
                    for three, a in more:
                        rest = two + b" " + three
                        phrase = one + b" " + rest
                        out.append((lang, two, slot_of(three, n_slots) if n_slots else 0, phrase, a, 1, l1, rest, None))
                        out.append((lang, three, 0, phrase, a, 2, n, three, counts.get((lang, three))))
                if len(out) >= 20_000:
                    yield _cut_batch(out)
                    out = []
            if out:
                yield _cut_batch(out)

    return united.mapInArrow(run, "lang string, word string, slot int, phrase string, a long, k int, l long, rest string, r long")


def _cut_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()).cast(t) if t == pa.string() and k else pa.array(c, t) for k, (c, t) in enumerate(zip(zip(*rows), kinds))], CUT)


def _composed(united: DataFrame, asked: DataFrame, shards: int) -> DataFrame:
    """`asked` cuts (lang, phrase, a, k, l, r) with r from the automaton of the prefix that the rest begins with: prefix rows and
    cuts meet by prefix, the row first, and the rest's arcs are followed."""
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("phrase", "string"), ("a", "long"), ("k", "int"), ("l", "long"), ("rest", "string"))]
    rows = united.select("lang", "word", "slot", "n1", "w2", "n2", *nothing)
    cuts = asked.select("lang", "word", "slot", *(F.lit(None).cast(t).alias(c) for c, t in (("n1", "long"), ("w2", "binary"), ("n2", "binary"))), "phrase", "a", "k", "l", "rest")
    met = rows.union(cuts).repartition(shards, "lang", "word", "slot").sortWithinPartitions("lang", "word", "slot", F.col("n1").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        n1, arcs = 0, {}
        for batch in batches:
            b = {c: batch.column(c).cast(pa.binary()).to_pylist() if c in ("rest", "w2") else batch.column(c).to_pylist() for c in ("n1", "w2", "n2", "rest")}
            at, r = [], []
            for i, (n, w2, n2, rest) in enumerate(zip(b["n1"], b["w2"], b["n2"], b["rest"])):
                if n is not None:
                    n1, arcs = n, dict(zip(w2[:-1].split(b" "), np.frombuffer(n2, "<i8").tolist())) if w2 else {}
                    continue
                _, blank, last = rest.partition(b" ")
                at.append(i)
                r.append(arcs[last] if blank else n1)
            picked = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("lang", "phrase", "a", "k", "l")]
            yield pa.RecordBatch.from_arrays([*picked, pa.array(r, pa.int64())], ["lang", "phrase", "a", "k", "l", "r"])

    return met.mapInArrow(run, "lang string, phrase string, a long, k int, l long, r long")


def phrases(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP, covered: int = COVERED, hot: int = HOT, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, block_names: int = BLOCK_NAMES, union_arcs: int = UNION_ARCS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases.

    Null texts are empty, a null language is `und`. Repeated rows count each; other columns don't matter; phrases of equal
    score and count are ranked by their bytes; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    words = staged(word_counts(texts, block_names), "words")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    bound = max(hot, total // HOT_WORDS)
    counts = {(r.lang, r.word.encode()): r.n for r in words.filter(F.col("n") > bound).toLocalIterator()}  # HOT_WORDS at most
    slots = {w: -(-n // bound) for w, n in counts.items()}
    send = spark.sparkContext.broadcast((counts, slots))
    shards = total // shard_words + 1
    blocks = _blocks(texts, spark.sparkContext.broadcast(slots), block_words, block_names)
    united = staged(_united(blocks, shards, least, union_arcs), "united")
    cuts = staged(_cuts(united, send), "cuts")
    known = cuts.filter("r IS NOT NULL").select("lang", "phrase", "a", "k", "l", "r")
    scored = known.union(_composed(united, cuts.filter("r IS NULL"), shards))
    exact = "CAST({} AS DECIMAL(18, 0))".format
    score = f"(CAST(1000000 AS DECIMAL(7, 0)) * ({exact('a')} * {exact('a')})) div ({exact('l')} * {exact('r')})"
    scored = scored.selectExpr("lang", "phrase", "a", f"struct({score} AS score, k, l, r) AS cut", "CAST(NULL AS BIGINT) AS longer")
    whole = cuts.filter("k = 2").select("lang", "a", F.split("phrase", " ").alias("w"))  # each phrase of three words once
    parts = whole.select("lang", "a", F.explode(F.array(F.concat_ws(" ", F.col("w")[0], F.col("w")[1]), F.concat_ws(" ", F.col("w")[1], F.col("w")[2]))).alias("phrase"))
    inside = parts.select("lang", "phrase", F.lit(0).cast("long").alias("a"), F.lit(None).cast(scored.schema["cut"].dataType).alias("cut"), F.col("a").alias("longer"))
    found = scored.union(inside).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min("cut").alias("cut"), F.max("longer").alias("longer"))
    found = found.filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
