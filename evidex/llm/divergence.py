"""Source divergence audit: how far the word use of each source departs from other sources and from its language.

Frequencies come by single-pass in-memory indexing. Each task reads its documents once and builds postings in memory, term
by term: the number of documents and the occurrences per source. When the block is full it is written out as a run, sorted
by language and term, and the next block begins. Runs are dealt to hash shards of terms; a shard merges its runs by a heap,
adds up the postings of equal terms and keeps the terms of enough documents. A block has one posting list a term, so a
common term costs a shard one row a block, not one row an occurrence; and the number of shards follows the bytes of the
texts, so a shard's runs fit in memory at any size.

A pair of sources is compared over all kept terms of the language, most of which neither has. So a pair starts from the
value of a term that both lack, times the number of terms. One correction follows for the terms that a source has, from the
counts of its counts; another for the terms that both have, streamed from the postings: a task adds up its terms' corrections
by pair and gives out sums, so the pairs of a term are never rows.

All figures are exact integers. The table of groups (language, source) is sent to all tasks; the result holds a row for
every pair of a language's sources, so it is far larger than that table.
"""

from __future__ import annotations

import heapq
import itertools
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import raw, slices, staged

#: Documents that a kept term is in at least, and terms reported per group.
LEAST_DOCS, TOP_TERMS = 10, 10
#: Postings that fill a block, and bytes of text per shard of terms.
BLOCK_POSTINGS, SHARD_BYTES = 400_000, 32 << 20
#: Pairs worked out at a time.
PAIRS = 1 << 20
SCALE = 1_000_000_000
_BLANK = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms_of(text: bytes, part: int = 4 << 20) -> Iterator[list[bytes]]:
    """A-Z lower-cased runs of ASCII letters and of everything beyond ASCII, in lists from about `part` bytes each."""
    text = text.lower().translate(_BLANK)
    at = 0
    while at < len(text):
        cut = text.find(b" ", at + part)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut].split()
        at = cut


class Block:
    """Postings in memory: per group the occurrences of each term, per language the documents that hold it."""

    def __init__(self, lang_of: list[int]):
        self.lang_of = lang_of
        self.clear()

    def clear(self) -> None:
        self.counts: dict[int, Counter] = {}
        self.docs: dict[int, Counter] = {}
        self.size = 0

    def add(self, group: int, text: bytes) -> None:
        counts = self.counts.setdefault(group, Counter())
        docs = self.docs.setdefault(self.lang_of[group], Counter())
        before = len(counts) + len(docs)
        lists = terms_of(text)
        first = next(lists, [])
        held = set(first)
        counts.update(first)
        for more in lists:
            counts.update(more)
            held.update(more)
        docs.update(held)
        self.size += len(counts) + len(docs) - before

    def run(self) -> pa.RecordBatch:
        """The postings as a run, sorted by language and term. The block is empty then."""
        import numpy as np

        langs, terms, docs, sizes, parts = [], [], [], [], []
        for lang in sorted(self.docs):
            seen = self.docs[lang]
            order = sorted(seen)
            rank = dict(zip(order, range(len(order))))
            mine = [(g, c) for g, c in sorted(self.counts.items()) if self.lang_of[g] == lang]
            at = np.concatenate([np.fromiter(map(rank.__getitem__, c), np.int64, len(c)) for _, c in mine])
            post = np.zeros(len(at), POSTING)
            post["group"] = np.repeat([g for g, _ in mine], [len(c) for _, c in mine])
            post["n"] = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for _, c in mine])
            by = np.argsort(at, kind="stable")
            langs.append(np.full(len(order), lang, np.int32))
            terms += order
            docs += map(seen.__getitem__, order)
            sizes.append(np.bincount(at, minlength=len(order)))
            parts.append(post[by])
        self.clear()
        ends = np.cumsum(np.concatenate([[0], *sizes])) * POSTING_BYTES
        packed = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.concatenate(parts).tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(langs)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(docs, pa.int64()), packed], ["lang", "term", "docs", "postings"])


POSTING, POSTING_BYTES = [("group", "<u4"), ("n", "<i8")], 12


def _runs(docs: DataFrame, groups: list[tuple[str, str]], block_postings: int) -> DataFrame:
    """(lang, term, docs, postings): every block's run. `docs` holds lang, source and text without nulls in the first two."""
    langs = sorted({lang for lang, _ in groups})
    number = {lang: k for k, lang in enumerate(langs)}
    send = docs.sparkSession.sparkContext.broadcast(({g: k for k, g in enumerate(groups)}, [number[lang] for lang, _ in groups]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group_of, lang_of = send.value
        block = Block(lang_of)
        for batch in batches:
            for rows in slices(batch, "text"):
                for lang, source, text in zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist(), raw(rows, "text")):
                    block.add(group_of[lang, source], text)
                    if block.size >= block_postings:
                        yield block.run()
        if block.size:
            yield block.run()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang int, term string, docs long, postings binary")


def sorted_runs(batches: Iterator[pa.RecordBatch]) -> list[list[pa.RecordBatch]]:
    """The ascending stretches of a stream of rows (lang, term, ...), each a list of slices."""
    import numpy as np
    import pyarrow.compute as pc

    runs: list[list[pa.RecordBatch]] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        lang, term = batch.column("lang"), batch.column("term")
        n = batch.num_rows - 1
        up = pc.or_(pc.less(lang[:n], lang[1:]), pc.and_(pc.equal(lang[:n], lang[1:]), pc.less(term[:n], term[1:])))
        cuts = [0, *(np.flatnonzero(~up.to_numpy(zero_copy_only=False)) + 1), n + 1]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            if k or last is None or last >= (lang[0].as_py(), term[0].as_py()):
                runs.append([])
            runs[-1].append(batch.slice(a, b - a))
        last = (lang[n].as_py(), term[n].as_py())
    return runs


def _rows(run: list[pa.RecordBatch]) -> Iterator[tuple]:
    """(lang, term, docs, postings), a few rows in Python's memory at a time."""
    for part in run:
        for at in range(0, part.num_rows, 1000):
            yield from zip(*(c.to_pylist() for c in part.slice(at, 1000).columns))


def merged_runs(runs: list[list[pa.RecordBatch]], least_docs: int) -> Iterator[tuple[int, str, int, list[bytes]]]:
    """(lang, term, docs, posting lists) of the terms of enough documents: sorted runs merged by a heap."""
    for (lang, term), rows in itertools.groupby(heapq.merge(*map(_rows, runs)), key=lambda r: r[:2]):
        rows = [*rows]
        n = sum(r[2] for r in rows)
        if n >= least_docs:
            yield lang, term, n, [r[3] for r in rows]


def _added(rows: list[tuple[int, str, int, list[bytes]]]) -> pa.RecordBatch:
    """Merged terms with their postings added up by group."""
    import numpy as np

    post = np.frombuffer(b"".join(p for r in rows for p in r[3]), POSTING)
    at = np.repeat(np.arange(len(rows)), [sum(map(len, r[3])) // POSTING_BYTES for r in rows])
    order = np.lexsort((post["group"], at))
    at, group = at[order], post["group"][order].astype(np.int64)
    new = np.flatnonzero(np.r_[True, (np.diff(at) != 0) | (np.diff(group) != 0)])
    n = np.add.reduceat(post["n"][order].astype(np.int64), new)
    ends = pa.array(np.searchsorted(at[new], np.arange(len(rows) + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (group[new].astype(np.int32), n)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.int64()), *lists], ["lang", "term", "docs", "group", "n"])


def _frequencies(docs: DataFrame, groups: list[tuple[str, str]], least_docs: int, block_postings: int, shard_bytes: int) -> DataFrame:
    """(lang, term, docs, group, n): kept terms, by numbers of languages and groups; `group` and `n` are lists."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-size // shard_bytes) or 1

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = merged_runs(sorted_runs(batches), least_docs)
        while rows := [*itertools.islice(kept, 5000)]:
            yield _added(rows)

    runs = _runs(docs, groups, block_postings)
    return runs.repartition(shards, "lang", "term").mapInArrow(merge, "lang int, term string, docs long, `group` array<int>, n array<long>")


def _known(docs: DataFrame, lang: str, source: str, text: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Texts with languages and sources where null is empty, and the sorted groups."""
    plain = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))
    return plain, sorted((r.lang, r.source) for r in plain.select("lang", "source").distinct().toLocalIterator())


def frequencies(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, block_postings: int = BLOCK_POSTINGS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, term, docs, source, n): each language's terms in at least `least_docs` documents and their occurrences by source.

    Null texts, languages and sources are empty; repeated rows count each; other columns don't matter; an empty table gives an
    empty result.
    """
    plain, groups = _known(docs, lang, source, text)
    found = staged(_frequencies(plain, groups, least_docs, block_postings, shard_bytes), "frequencies")
    names = _names(docs, groups)
    return found.select("term", "docs", F.explode(F.arrays_zip("group", "n")).alias("x")).select("term", "docs", "x.group", "x.n").join(names, "group").select("lang", "term", "docs", "source", "n")


def _names(docs: DataFrame, groups: list[tuple[str, str]]) -> DataFrame:
    return docs.sparkSession.createDataFrame([(k, *g) for k, g in enumerate(groups)], "`group` int, lang string, source string")


def scaled(n, total):
    """1 + floor(10^9 n / total) for arrays with 0 <= n <= total, by long division in steps of a thousand: totals up to
    9 * 10^15 don't overflow."""
    out, rest = n // total, n % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def _f(p, q):
    return (p - q) * (p - q) // (p + q)


class PairSums:
    """Sums by pair of groups, in bounded memory: full, they are given out and start again."""

    def __init__(self, n_groups: int, most: int):
        self.n, self.most, self.keys, self.values, self.size = n_groups, most, [], [], 0

    def add(self, a, b, value) -> None:
        self.keys.append(a.ravel() * self.n + b.ravel())
        self.values.append(value.ravel())
        self.size += value.size

    def compact(self) -> None:
        import numpy as np

        if self.keys:
            keys, values = np.concatenate(self.keys), np.concatenate(self.values)
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
            self.keys, self.values = [keys[new]], [np.add.reduceat(values[order], new) if len(new) else values]
            self.size = len(new)

    def out(self) -> pa.RecordBatch:
        keys, values = self.keys[0], self.values[0]
        self.keys, self.values, self.size = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array((keys // self.n).astype("int32")), pa.array((keys % self.n).astype("int32")), pa.array(values)], ["a", "b", "value"])


def _shared(found: DataFrame, totals, pairs: int = PAIRS) -> DataFrame:
    """(a, b, value), a < b: sums of the corrections for the terms that both groups have, a few partial sums a pair.
    `totals`: arrays by group of N + 2 V."""
    send = found.sparkSession.sparkContext.broadcast(totals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total = send.value
        zero = scaled(np.full(len(total), 2, np.int64), np.maximum(total, 2))
        sums = PairSums(len(total), pairs)
        for batch in batches:
            group = batch.column("group").flatten().to_numpy().astype(np.int64)
            p = scaled(batch.column("n").flatten().to_numpy() + 2, total[group])
            sizes = np.diff(batch.column("group").offsets.to_numpy()).astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            for k in np.unique(sizes[sizes > 1]).tolist():
                mine = starts[sizes == k]
                step = max(1, pairs // k)  # rows of the upper triangle at a time, then terms at a time
                for low in range(0, k - 1, step):
                    left, right = _triangle(k, low, min(low + step, k - 1))
                    for at in range(0, len(mine), max(1, pairs // len(left))):
                        some = mine[at : at + max(1, pairs // len(left)), None]
                        i, j = some + left, some + right
                        a, b, pa_, pb = group[i], group[j], p[i], p[j]
                        za, zb = zero[a], zero[b]
                        sums.add(a, b, _f(pa_, pb) - _f(pa_, zb) - _f(za, pb) + _f(za, zb))
                        if sums.size > 4 * pairs:
                            sums.compact()
                            if sums.size > pairs:
                                yield sums.out()
        sums.compact()
        if sums.size:
            yield sums.out()

    return found.select("group", "n").mapInArrow(run, "a int, b int, value long")


def _triangle(k: int, low: int, high: int):
    """Places (i, j), i < j < k, of the rows i from `low` to `high`."""
    import numpy as np

    i = np.arange(low, high)
    left = np.repeat(i, k - 1 - i)
    return left, np.concatenate([np.arange(x + 1, k) for x in i]) if len(i) else left


def _p(n: str, total: str) -> str:
    """1 + floor(10^9 (n + 2) / total) in SQL, exact."""
    return f"(1 + (CAST({n} + 2 AS DECIMAL(20, 0)) * CAST({SCALE} AS DECIMAL(10, 0))) div CAST({total} AS DECIMAL(20, 0)))"


def _distance(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


def _pairs(groups: DataFrame, posts: DataFrame, shared: DataFrame) -> DataFrame:
    """(a, b, value) of every ordered pair of a language's groups. `groups`: group, lang, v, total, p0; `posts`: group, n."""
    one = groups.select("lang", F.col("group").alias("a"), F.col("p0").alias("p0a"), F.col("total").alias("total_a"), "v")
    other = groups.select("lang", F.col("group").alias("b"), F.col("p0").alias("p0b"))
    both = one.join(other, "lang").filter("a <> b")
    lacking = both.selectExpr("a", "b", f"v * {_distance('p0a', 'p0b')} AS value")
    counts = posts.groupBy(F.col("group").alias("a"), "n").agg(F.count("*").alias("terms"))
    having = counts.join(both, "a").selectExpr("a", "b", f"{_p('n', 'total_a')} AS p", "p0a", "p0b", "terms")
    having = having.selectExpr("a", "b", f"terms * ({_distance('p', 'p0b')} - {_distance('p0a', 'p0b')}) AS value").groupBy("a", "b").agg(F.sum("value").alias("value"))
    either = having.union(shared)
    turned = either.select("b", "a", "value")
    return lacking.union(either).union(turned).groupBy("a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, block_postings: int = BLOCK_POSTINGS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has every other source of the language by how far its word use is,
    part `term` the `top` terms that the source uses more than its language does.

    Null texts, languages and sources are empty. A group without terms is compared like any other; where a language keeps no
    term, all its pairs have the value 0. Repeated rows count each, other columns don't matter, ties are ranked by item. An
    empty table gives an empty result.
    """
    import numpy as np

    spark = docs.sparkSession
    plain, known = _known(docs, lang, source, text)
    found = staged(_frequencies(plain, known, least_docs, block_postings, shard_bytes), "frequencies")
    posts = found.select("lang", "term", F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x).alias("n_lang"), F.explode(F.arrays_zip("group", "n")).alias("x")).select("lang", "term", "n_lang", "x.group", "x.n")
    kept = {r.lang: r.v for r in found.groupBy("lang").agg(F.count("*").alias("v")).collect()}  # a row a language
    n_group = {r.group: r.n for r in posts.groupBy("group").agg(F.sum("n").alias("n")).toLocalIterator()}  # a row a group
    langs = sorted({x for x, _ in known})
    rows = []
    n_lang = dict.fromkeys(langs, 0)
    for g, (x, y) in enumerate(known):
        v, n = kept.get(langs.index(x), 0), n_group.get(g, 0)
        n_lang[x] += n
        rows.append((g, x, y, v, n + 2 * v, 1 + SCALE * 2 // (n + 2 * v) if v else 0))
    totals = np.array([r[4] for r in rows], np.int64)
    groups = spark.createDataFrame(rows, "`group` int, lang string, source string, v long, total long, p0 long")
    pairs = _pairs(groups.filter("v > 0"), posts, _shared(found, totals))
    silent = groups.filter("v = 0").select("lang", F.col("group").alias("a"))
    silent = silent.join(silent.withColumnRenamed("a", "b"), "lang").filter("a <> b").select("a", "b", F.lit(0).cast("long").alias("value"))
    names = groups.select("group", "lang", "source")
    pairs = pairs.union(silent).join(names.withColumnRenamed("group", "a"), "a").join(names.select(F.col("group").alias("b"), F.col("source").alias("item")), "b")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    of_lang = spark.createDataFrame([(k, n_lang[x] + 2 * kept.get(k, 0)) for k, x in enumerate(langs)], "lang int, total_lang long")
    terms = posts.join(of_lang, "lang").drop("lang").join(groups, "group")
    terms = terms.selectExpr("lang", "source", "term AS item", f"{_p('n', 'total')} AS p", f"{_p('n_lang', 'total_lang')} AS q").filter("p > q")
    terms = terms.selectExpr("lang", "source", "item", f"{_distance('p', 'q')} AS value").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.union(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
