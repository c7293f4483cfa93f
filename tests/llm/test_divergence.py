"""The source divergence audit against a plain count with whole matrices."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from evidex.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def brute(rows, least=10, top=10):
    """rows: (lang, source, text)."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for lang, source, text in rows:
        words = TERM.findall(lower(text or ""))
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for x, s in groups if x == lang)

        def p(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        each = {s: p(counts[lang, s]) for s in sources}
        whole = p(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            mine = [("pair", o, sum(f(each[s][t], each[o][t]) for t in kept)) for o in sources if o != s]
            terms = [("term", t, f(each[s][t], whole[t])) for t in kept if counts[lang, s][t] and each[s][t] > whole[t]]
            for part, most in ((mine, None), (terms, top)):
                part.sort(key=lambda r: (-r[2], r[1].encode()))
                out += [(lang, s, *r, k + 1) for k, r in enumerate(part[:most])]
    return sorted(out)


def made(seed, n=400):
    rng = random.Random(seed)
    words = ["the", "Alpha", "été", "ÉTÉ", "x", "日本", "don't", "a1b", "😀", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "de", None, "fr"])
        source = rng.choice(["s0"] * 5 + ["s1", "s2", "S2", "é", None])
        text = None if rng.random() < 0.05 else " ".join(rng.choice(words[: rng.randint(2, len(words))]) for _ in range(rng.randint(0, 30)))
        rows.append((lang, source, text))
    return rows + [("fr", "mute", ""), ("it", "one", "solo"), ("it", "two", None), ("xx", "only", "a b c")]


@pytest.mark.parametrize("block, shard", [(400_000, 32 << 20), (30, 2000)])
def test_against_brute_force(spark, block, shard):
    rows = made(block)
    docs = spark.createDataFrame([(*r, 7, "clash") for r in rows], "lang string, source string, text string, value int, term string").repartition(5)
    got = divergence.audit(docs, block_postings=block, shard_bytes=shard)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_frequencies(spark):
    rows = made(3)
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    want, held = Counter(), defaultdict(set)
    for k, (lang, source, text) in enumerate(rows):
        for t in TERM.findall(lower(text or "")):
            want[lang or "", t, source or ""] += 1
            held[lang or "", t].add(k)
    want = {(x, t, len(held[x, t]), s, n) for (x, t, s), n in want.items() if len(held[x, t]) >= 4}
    assert {tuple(r) for r in divergence.frequencies(docs, least_docs=4, block_postings=50).collect()} == want


def test_empty(spark):
    none = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(none).count() == 0 and divergence.frequencies(none).count() == 0
    assert divergence.audit(spark.createDataFrame([(None, None, None)], none.schema)).count() == 0


def test_long_texts_are_read_in_parts():
    text = ("Alpha " * 1000 + "b" * 5000 + " ").encode()
    parts = [*divergence.terms_of(text, 100)]
    assert len(parts) > 10 and sum(parts, []) == [b"alpha"] * 1000 + [b"b" * 5000]
    block = divergence.Block([0])
    block.add(0, text)
    assert dict(zip(block.run().column("term").to_pylist(), [1, 1])) == {"alpha": 1, "b" * 5000: 1}


def test_exact_beyond_64_bits():
    rng = random.Random(1)
    n = [rng.randrange(10**k + 1) for k in range(15) for _ in range(20)]
    total = [max(x, 1) * rng.randrange(1, 6) + rng.randrange(3) for x in n]
    assert divergence.scaled(np.array(n), np.array(total)).tolist() == [1 + 10**9 * x // t for x, t in zip(n, total)]


def test_heap_merge_of_runs():
    """Runs that cross batches, batches that hold several runs, and a run that begins where the last ended."""
    rng = random.Random(4)
    want, stream = Counter(), []
    for _ in range(30):
        run = sorted({(rng.randrange(2), rng.choice("abcdefghij") * rng.randint(1, 2)) for _ in range(rng.randint(1, 15))})
        want.update(run)
        stream += run
    schema = pa.schema([("lang", pa.int32()), ("term", pa.string()), ("docs", pa.int64()), ("postings", pa.binary())])
    batches = [pa.RecordBatch.from_pylist([{"lang": x, "term": t, "docs": 1, "postings": b"p"} for x, t in stream[k : k + 7]], schema=schema) for k in range(0, len(stream), 7)]
    runs = divergence.sorted_runs(iter([batches[0].slice(0, 0), *batches]))
    assert len(runs) <= 30
    got = [*divergence.merged_runs(runs, 3)]
    assert [(x, t) for x, t, _, _ in got] == sorted(k for k, n in want.items() if n >= 3)
    assert all(n == want[x, t] and len(p) == n for x, t, n, p in got)


@pytest.mark.parametrize("pairs", [1 << 20, 5, 1])
def test_pair_corrections_in_small_steps(spark, pairs):
    """Long posting lists in parts, sums given out before the end."""
    rng = random.Random(pairs)
    totals = np.array([rng.randrange(50, 90) for _ in range(9)], np.int64)
    lists = [sorted(rng.sample(range(9), rng.randint(1, 9))) for _ in range(40)]
    rows = [(g, [rng.randrange(1, 20) for _ in g]) for g in lists]
    found = spark.createDataFrame(rows, "`group` array<int>, n array<long>").coalesce(1)
    p = lambda n, g: 1 + 10**9 * (n + 2) // int(totals[g])
    f = lambda a, b: (a - b) ** 2 // (a + b)
    want = Counter()
    for gs, ns in rows:
        for i in range(len(gs)):
            for j in range(i + 1, len(gs)):
                a, b = gs[i], gs[j]
                want[a, b] += f(p(ns[i], a), p(ns[j], b)) - f(p(ns[i], a), p(0, b)) - f(p(0, a), p(ns[j], b)) + f(p(0, a), p(0, b))
    got = Counter()
    for r in divergence._shared(found, totals, pairs).collect():
        got[r.a, r.b] += r.value
    assert got == want


def test_query_against_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = db.execute(queries.ORACLES["op12_divergence"]).fetchall()
    assert sorted(map(tuple, queries.QUERIES["op12_divergence"](spark, sf).collect())) == sorted(want)
