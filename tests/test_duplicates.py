"""Near duplicates without a subject: links at the very bound, and what a run shuffles."""

import os
from collections import Counter

import numpy as np
from evidex.operators import vectors
from evidex.plans import QUERIES


def rows(spark, items):
    return spark.createDataFrame([(k, *v) for k, v in items.items()], "id long, vector array<double>, object array<string>, words array<string>")


def test_no_link_is_missed(spark):
    """Vectors around one, most pairs just within the distance; all words are alike."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=64)
    noise = rng.normal(size=(400, 64)) * 0.242
    words = [f"w{k}" for k in range(40)]
    items = {i: ((centre + x).tolist(), words[:2], words) for i, x in enumerate(noise)}
    m = np.array([v[0] for v in items.values()])
    m /= np.sqrt((m * m).sum(1, keepdims=True))
    linked = np.round(1 - m @ m.T, 9) <= 0.06
    assert 0.2 < linked.mean() < 0.8
    got = {r.id: r.n_links for r in vectors.duplicate_classes(rows(spark, items)).collect()}
    assert got == dict(enumerate((linked.sum(1) - 1).tolist()))


def test_sizes_far_apart(spark):
    """Blocks of few sketches of several lengths: copies cut to more or less than the overlap, one word, zero vectors."""
    rng = np.random.default_rng(5)
    items = {}
    for n in (1, 2, 30, 200, 1200, 3000):
        words = [f"a{n}-{k}" for k in range(n)]
        for share in (1, 0.9, 0.61, 0.6, 0.59, 0.4):
            for extra in range(2):
                mine = words[: round(n * share)] + [f"x{rng.integers(1 << 40)}" for _ in range(extra)]
                items[len(items)] = ([float(n), 1.0, 0.0], mine[:2], mine)
    items |= {len(items) + k: ([0.0] * 3, ["a"], ["a"]) for k in range(3)}
    want = Counter()
    for a, (va, oa, wa) in items.items():
        for b, (vb, ob, wb) in items.items():
            x, y = set(wa), set(wb)
            near = any(va) and any(vb) and round(1 - np.dot(va, vb) / np.linalg.norm(va) / np.linalg.norm(vb), 9) <= 0.06
            want[a] += a != b and near and len(x & y) / max(1, len(x | y)) >= 0.6 and set(oa) <= y and set(ob) <= x
    assert max(want.values()) > 3
    for block in (4, 1 << 17):
        assert {r.id: r.n_links for r in vectors.duplicate_classes(rows(spark, items), slot=3, block=block).collect()} == want


def test_shuffles_less_than_the_texts(spark):
    """Whole rows are sent for members of groups alone."""
    sf = "/root/testdata/sf0.1"

    def written() -> int:
        sc = spark.sparkContext
        none = sc._jvm.java.util.ArrayList()
        stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = written()
    assert QUERIES["d05_duplicate_links"](spark, sf).count() == 10_000
    assert written() - before < 3 * os.path.getsize(f"{sf}/documents.parquet")
