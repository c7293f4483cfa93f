"""Phrase collocations against a plain count of all n-grams."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from evidex.llm import collocations, queries

PIECE, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def grams(text):
    text = "".join(c.lower() if c.isascii() else c for c in text or "")
    for piece in PIECE.split(text):
        words = WORD.findall(piece)
        for k in (1, 2, 3):
            for i in range(len(words) - k + 1):
                yield tuple(words[i : i + k])


def brute(rows, least=10, top=2000):
    """rows: (lang, text)."""
    f = {}
    for lang, text in rows:
        f.setdefault(lang or "und", Counter()).update(grams(text))
    out = []
    for lang, c in f.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        found = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        longer = Counter()
        for k, v in found.items():
            if len(k) == 3:
                for part in (k[:2], k[1:]):
                    longer[part] = max(longer[part], v)
        best = []
        for k, a in found.items():
            if 100 * longer[k] >= 50 * a:
                continue
            score, cut = min((10**6 * a * a // (c[k[:i]] * c[k[i:]]), i) for i in range(1, len(k)))
            best.append((-score, -a, " ".join(k).encode(), c[k[:cut]], c[k[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


def made(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "the", "the", "New", "York", "new york", "City", "état", "ÉTAT", "日本", "a.b", "x;", "y\n", "\x1c", "end?", "😀", "of the", "of"]
    rows = [(rng.choice(["en", "en", "de", None]), None if rng.random() < 0.05 else rng.choice([" ", "  ", "\t"]).join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for _ in range(n)]
    return rows + [("fr", ""), ("fr", None), ("it", "a b c"), ("und", "new york city " * 30)]


@pytest.mark.parametrize("options", [{}, {"hot": 40, "block_words": 500, "shard_words": 1000, "union_arcs": 20}, {"hot": 5, "block_names": 6, "union_arcs": 3}])
def test_against_brute_force(spark, options):
    """One block and many, no hot words and many, prefixes united at once and bit by bit."""
    rows = made(len(options))
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, text string, word string, n int").repartition(4)
    assert sorted(map(tuple, collocations.phrases(docs, **options).collect())) == brute(rows)


def test_parameters(spark):
    rows = made(9)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.phrases(docs, least=4, top=7).collect())) == brute(rows, 4, 7)


def test_empty(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.phrases(none).count() == 0
    assert collocations.phrases(spark.createDataFrame([(None, None), ("x", " .,; ")], none.schema)).count() == 0


def test_long_texts_are_read_in_parts():
    text = ("New york, " * 1000 + "c" * 3000).encode()
    whole, parts = [*collocations.tokens_of(text)], [*collocations.tokens_of(text, 50)]
    assert len(whole) == 1 and len(parts) > 50 and sum(parts, []) == whole[0]


def test_transducer_and_union():
    """Blocks of one sequence of texts, united, hold the counts of the whole."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 20))).encode() for _ in range(60)]
    rows = []
    for at in range(0, 60, 10):
        names = [b"", *sorted({w for t in texts[at : at + 10] for w in t.split()})]
        numbers = np.array([x for t in texts[at : at + 10] for x in [*map(names.index, t.split()), 0]], np.int64)
        rows.append(collocations.prefixes(collocations.Transducer(numbers), "en", names, {("en", b"c"): 2}))
    rows = pa.concat_batches(rows)
    rows = rows.take(pc.sort_indices(rows, [("word", "ascending"), ("slot", "ascending")]))
    want = Counter(g for t in texts for g in grams(t.decode()))
    got = Counter()
    for row in zip(*(c.to_pylist() for c in collocations.union(rows, 3).columns)):
        if row[1] != "c":
            got[(row[1],)] = row[3]
        for two, n, more in collocations._grams(row):
            got[row[1], two.decode()] = n
            got.update({(row[1], two.decode(), three.decode()): m for three, m in more})
    assert got == Counter({k: n for k, n in want.items() if n >= 3 and k != ("c",)})


def test_query_against_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = db.execute(queries.ORACLES["op13_collocations"]).fetchall()
    assert sorted(map(tuple, queries.QUERIES["op13_collocations"](spark, sf).collect())) == sorted(want)
