import math
import random
from collections import Counter

import numpy as np
import pytest
from evidex.llm import ngram_lm as N
from pyspark.sql import functions as F


def test_elias_fano():
    rng = random.Random(1)
    for n, top in [(0, 1), (1, 1), (1, 2**63), (5, 6), (500, 400), (500, 2**20), (3000, 2**62), (40, 2**64 - 1)]:
        values = np.array(sorted(rng.randrange(top) for _ in range(n)), np.uint64)
        e = N.EliasFano(values)
        assert (e.get(np.arange(n)) == values).all()
        asked = np.unique(np.r_[values, np.array([rng.randrange(top) for _ in range(300)], np.uint64)])
        first = {int(v): i for i, v in reversed(list(enumerate(values)))}
        assert e.find(asked).tolist() == [first.get(int(v), -1) for v in asked]


def test_level_against_plain_counts():
    rng = random.Random(2)
    pairs = sorted({(rng.randrange(50) << 30, rng.randrange(2**40)) for _ in range(2000)})
    counts = np.array([rng.randrange(1, 50) for _ in pairs], np.int64)
    u, w = (np.array(x, np.uint64) for x in zip(*pairs))
    total = {int(x): int(counts[u == x].sum()) for x in np.unique(u)}
    level = N.Level(u, w, counts, 10.0).mapped()
    q, b = level.ask(np.r_[u, u[:5], [7]].astype(np.uint64), np.r_[w, w[:5] ^ np.uint64(1), [7]].astype(np.uint64))
    want = np.array([c / (total[int(x)] + 10) for x, c in zip(u, counts)])
    assert np.abs(np.log10(N.restored(q[: len(u)])) - np.log10(want)).max() <= N.STEP / 2 + 1e-9
    assert (q[len(u) :] == 0).all() and b[-1] == 1
    back = np.array([10 / (total[int(x)] + 10) for x in u])
    assert np.abs(np.log10(N.restored(b[: len(u)])) - np.log10(back)).max() <= N.STEP / 2 + 1e-9
    assert level.pointers.get(np.arange(51)).tolist() == [*np.flatnonzero(np.r_[True, u[1:] != u[:-1]]), len(u)]


def test_unigrams_against_plain_counts():
    rng = random.Random(3)
    words = np.array(sorted({rng.randrange(2**64) for _ in range(3000)}), np.uint64)
    counts = np.array([rng.choice([1, 2, 50, 10**9]) for _ in words], np.int64)
    level = N.Unigrams(words, counts, int(counts.sum())).mapped()
    c, q = level.ask(np.r_[words, words[:9] ^ np.uint64(1)])
    assert (c[: len(words)] == counts).all() and (c[len(words) :] == 0).all() and (q[len(words) :] == 0).all()
    assert np.abs(-N.FINE * (q[: len(words)].astype(float) - 1) - np.log10((counts + 0.5) / counts.sum())).max() <= N.FINE / 2 + 1e-9
    assert [x.tolist() for x in N.Unigrams(words[:0], counts[:0], 0).mapped().ask(words[:2])] == [[0, 0], [0, 0]]


def slow(rows, mu):
    """(n_tokens, n_known, N, base, model) by row with plain counts; the model's parts quantised as the trie's are."""
    def cut(x):
        return float(N.restored(N.quantised(np.array([math.log10(x)])))[0])

    lists = [[*(w.decode() for w in (t or "").encode().lower().split()), None] for _, t, _ in rows]
    one, two = Counter(), Counter()
    for words, (_, _, held) in zip(lists, rows):
        if not held:
            one.update(words)
            two.update(zip([None, *words], words))
    n, v = sum(one.values()), len(one)
    out = []
    for words in lists:
        base = model = 0.0
        for u, w in zip([None, *words], words):
            p = (one[w] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            known = cut(two[u, w] / (one[u] + mu)) if two[u, w] else 0.0
            fine = 10 ** (-N.FINE * round(-math.log10((one[w] + 0.5) / n) / N.FINE)) * n if one[w] else 0.5
            model += math.log10(known + (cut(mu / (one[u] + mu)) if one[u] else 1.0) * fine / (n + 0.5 * (v + 1)))
        out.append((len(words), sum(one[w] > 0 for w in words), n, base, model))
    return out


def corpus():
    rng = random.Random(4)
    vocab = [f"W{i}" for i in range(60)] + ["é", "ß"]
    rows = [(i, " ".join(rng.choices(vocab[: 5 + i % 60], k=rng.randrange(0, 80))), rng.random() < 0.2) for i in range(200)]
    return rows + [(200, None, False), (201, "", True), (202, " \t\n", False), (203, "only unseen", True), (204, "w1\x0bw2\x0cW3", False), (205, "x " * 3000, True)]


@pytest.mark.parametrize("options", [{}, {"block_tokens": 300, "shard_bytes": 3000, "hot_share": 0.02}])
def test_against_plain_counts(spark, options):
    rows = corpus() + corpus()[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean").selectExpr("*", "1 AS block", "2 AS ids", "3 AS score")
    got = N.score(docs, F.col("held"), mu=20.0, **options).collect()
    want = sorted((i, h, *s) for (i, _, h), s in zip(rows, slow(rows, 20.0)))
    assert len(got) == len(want)
    for r, w in zip(sorted(map(tuple, got)), want):
        assert r[:5] == w[:5] and np.allclose(r[5:], w[5:], rtol=1e-9), (r, w)


def test_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert N.score(docs, F.lit(False)).collect() == []
    all_held = spark.createDataFrame([(1, "a b"), (None, "a")], "doc_id long, text string")
    assert [r.n_known for r in N.score(all_held, F.lit(True)).collect()] == [0, 0]


def test_held_out_texts_score_better_than_unigrams(spark):
    rng = random.Random(5)
    follow = {i: [rng.randrange(200) for _ in range(3)] for i in range(200)}

    def text():
        at, out = rng.randrange(200), []
        for _ in range(60):
            out.append(f"w{at}")
            at = rng.choice(follow[at])
        return " ".join(out)

    docs = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string")
    rows = [r for r in N.score(docs, F.col("doc_id") % 5 == 1, mu=50.0).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.7 * sum(r.base_score for r in rows)
