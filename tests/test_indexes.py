"""Prefix index, cover density, vector cells, near-duplicate classes, mirrors, reachability, as-of join, automaton."""

import itertools
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from evidex.operators import automaton, graph, prefixes, proximity, quality, temporal, vectors

# ---- prefixes


def key(url):
    url = url or ""
    bare = url.split("#")[0].split("?")[0]
    if "://" in bare:
        host, _, path = bare.split("://", 1)[1].partition("/")
        return (host + ("/" + path).rstrip("/")).lower() if path or bare.endswith("/") else host.lower()
    return bare.rstrip("/").lower()


URLS = ["https://a.org", "https://a.org/", "http://A.org/x", "https://a.org/x/", "https://a.org/x/y?q=1#f", "https://a.org/xy", "https://b.a.org/x", "a.org/x/y", "", None, "https://a.o"]


def test_url_keys(spark):
    rows = spark.createDataFrame([(u,) for u in URLS], "u string")
    assert [r.k for r in rows.select(prefixes.url_key("u").alias("k")).collect()] == [key(u) for u in URLS]


def test_authoritative_recall_against_all_pairs(spark):
    """Nested prefixes, repeated and empty addresses, both directions, questions without sources or without results."""
    rng = random.Random(3)
    for seed in range(2):
        sources = [(q, rng.choice(URLS)) for q in range(6) for _ in range(rng.randint(0, 4))]
        seen = [(q, rng.choice(URLS)) for q in range(7) for _ in range(rng.randint(0, 3))]
        got = prefixes.authoritative_recall(spark.createDataFrame([(q,) for q in range(8)], "q int"), spark.createDataFrame(sources, "q int, u string"), spark.createDataFrame(seen, "q int, u string"), "q", "u")
        for r in got.collect():
            mine, near = [key(u) for q, u in sources if q == r.q], {key(u) for q, u in seen if q == r.q}
            found = [s for s in mine if any(k.startswith(s) or s.startswith(k) for k in near)]
            assert (r.n_sources, r.n_found) == (len(mine), len(found))
            assert r.value == (len(found) / len(mine) if mine else None) and r.ok == (not mine or bool(found))


# ---- cover density


def plain_covers(pos, term, n):
    whole = [(i, j) for i in range(len(pos)) for j in range(i, len(pos)) if len(set(term[i : j + 1])) == n]
    return [(i, j) for i, j in whole if not any((a, b) != (i, j) and i <= a and b <= j for a, b in whole)]


def test_minimal_intervals():
    rng = random.Random(1)
    for _ in range(400):
        n, size = rng.randint(1, 4), rng.randint(0, 14)
        pos = np.array(sorted(rng.sample(range(1, 60), size)), np.int64)
        term = np.array([rng.randrange(n) for _ in range(size)], np.int64)
        first, end = proximity.covers(pos, term, n)
        assert list(zip(first.tolist(), end.tolist())) == plain_covers(pos, term.tolist(), n)


def test_density(spark):
    texts = {1: ("gear box", "the gear turns the box and the gear"), 2: ("box", "gear"), 3: (None, "gear gear gear"), 4: ("", ""), 5: ("x y z", "box far far far gear")}
    docs = spark.createDataFrame([(k, a.split() if a is not None else None, b.split()) for k, (a, b) in texts.items()], "id int, title array<string>, body array<string>")
    posts = proximity.positional(docs, "id", [(docs.title, "A"), (docs.body, "D")])
    terms = spark.createDataFrame([(0, "gear"), (0, "box"), (1, "gear"), (2, "gear"), (2, "absent")], "query int, term string")
    got = {(r.query, r.id): (r.n_covers, r.density) for r in proximity.all_terms(terms, posts).collect()}
    each = {(r.query, r.id): (r.n_covers, r.density) for r in proximity.any_term(terms, posts).collect()}
    want, any_ = {}, {}
    for q, asked in ((0, ["box", "gear"]), (1, ["gear"]), (2, ["gear", "absent"])):
        for k, (a, b) in texts.items():
            words = [(w, 1.0) for w in (a or "").split()] + [(w, 0.1) for w in b.split()]
            hits = [(i + 1, asked.index(w), x) for i, (w, x) in enumerate(words) if w in asked]
            if not hits:
                continue
            any_[q, k] = len(hits), sum(x for _, _, x in hits) / np.log(len(words) + 1)
            found = plain_covers([h[0] for h in hits], [h[1] for h in hits], len(asked))
            if found:
                total = sum((j - i + 1) / sum(1 / h[2] for h in hits[i : j + 1]) / (1 + (hits[j][0] - hits[i][0]) - (j - i)) for i, j in found)
                want[q, k] = len(found), total / np.log(len(words) + 1)
    assert got.keys() == want.keys() and each.keys() == any_.keys()
    assert all(got[k][0] == n and abs(got[k][1] - x) < 1e-12 for k, (n, x) in want.items())
    assert all(each[k][0] == n and abs(each[k][1] - x) < 1e-12 for k, (n, x) in any_.items())


# ---- vectors


def brute_nearest(queries, items, k, same=lambda q, i: True):
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    out = []
    for q, (v, *key_) in queries.items():
        far = sorted((round(1 - float(unit(v) @ unit(w)), 6), i) for i, (w, *other) in items.items() if key_ == other and same(q, i))
        out += [(q, i, d, n + 1) for n, (d, i) in enumerate(far[:k])]
    return sorted(out)


def test_nearest_by_tiles(spark):
    """Slots of a few rows, a hot key, ties by id, keys without partner, the zero vector."""
    rng = np.random.default_rng(0)
    items = {i: (np.round(rng.normal(size=4)), "hot" if i % 4 else f"k{i % 3}") for i in range(90)}
    queries = {i: items[i] for i in range(0, 90, 7)} | {1000: (np.ones(4), "nobody"), 1001: (np.zeros(4), "hot")}
    rows = lambda d, name: spark.createDataFrame([(k, v.tolist(), g) for k, (v, g) in d.items()], f"{name} long, vector array<double>, g string")
    got = vectors.nearest(rows(queries, "query"), rows(items, "id"), 5, "g", others_only=True, slot=8)
    assert sorted(map(tuple, got.collect())) == brute_nearest(queries, items, 5, lambda q, i: q != i)
    free = vectors.nearest(rows(queries, "query"), rows(items, "id"), 5, slot=8)
    assert sorted(map(tuple, free.collect())) == brute_nearest({q: v[:1] for q, v in queries.items()}, {i: v[:1] for i, v in items.items()}, 5)
    assert vectors.nearest(rows(queries, "query"), rows(items, "id").limit(0), 5).count() == 0


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.1"])
def test_cells_recall(spark, scale):
    """Every twentieth vector against all rows: at least nine of the ten nearest are found."""
    v = spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
    asked = v.filter("id % 20 = 0").withColumnRenamed("id", "query")
    cells = vectors.fit_cells(v)
    indexed = cells.of(v).cache()
    assert indexed.count() == v.count()
    got = {(r.query, r.id) for r in vectors.search_cells(asked, indexed, cells, 10, others_only=True).collect()}
    want = {(r.query, r.id) for r in vectors.nearest(asked, v, 10, others_only=True).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)
    indexed.unpersist()


def test_cells_search_less_of_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(12, 16))
    rows = [(i, (centre[i % 12] + 0.1 * rng.normal(size=16)).tolist()) for i in range(600)]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    cells = vectors.fit_cells(v)
    assert cells.probes < len(cells.centroids) / 2
    assert vectors.fit_cells(v.limit(0)).probes == 1


def brute_links(items):
    links = defaultdict(set)
    for (a, (va, oa, wa)), (b, (vb, ob, wb)) in itertools.combinations(items.items(), 2):
        if not wa or not wb or not len(va) or not len(vb):
            continue
        near = 1 - np.dot(va, vb) / ((np.linalg.norm(va) or 1) * (np.linalg.norm(vb) or 1)) <= 0.06 + 5e-10
        x, y = set(wa), set(wb)
        if near and len(x & y) / len(x | y) >= 0.6 and set(oa) <= set(ob) | y and set(ob) <= set(oa) | x:
            links[a].add(b)
            links[b].add(a)
    found = {}
    for a in items:
        todo, seen = [a], {a}
        while todo:
            for c in links[todo.pop()] - seen:
                seen.add(c)
                todo.append(c)
        found[a] = min(seen), len(links[a])
    return found


def test_duplicate_classes(spark):
    """A hot group of near copies and exact copies, far ones, other objects, no words."""
    rng = random.Random(2)
    base = [f"w{k}" for k in range(30)]
    items = {}
    for i in range(160):
        words = [w for w in base if rng.random() < 0.85] if i % 3 else [f"w{rng.randrange(60)}" for _ in range(20)]
        words = [*words, "odd"] if i % 7 == 0 else words
        vector = [float(sum(hash_(w) == k for w in words)) for k in range(8)]
        items[i] = (vector, ["odd"] if i % 7 == 0 else words[:1], words)
    items |= {200: items[1], 201: items[1], 202: ([0.0] * 8, [], []), 203: ([0.0] * 8, [], [])}
    rows = spark.createDataFrame([(k, *v) for k, v in items.items()], "id long, vector array<double>, object array<string>, words array<string>")
    want = brute_links(items)
    assert max(n for _, n in want.values()) > 20
    for slot in (7, 512):
        assert {r.id: (r.class_id, r.n_links) for r in vectors.duplicate_classes(rows, slot=slot).collect()} == want


def hash_(w):
    return sum(map(ord, w)) * 7 % 8


def test_duplicate_classes_on_documents(spark):
    """The registered query against brute force over its own vectors."""
    from evidex.functions import text as X
    from evidex.plans import QUERIES
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", X.words("text").alias("w")).collect()
    items = {}
    for r in docs:
        bag = Counter((ord(x[0]) * 31 + ord(x[-1]) * 7 + len(x)) % 64 for x in r.w)
        items[r.doc_id] = (np.array([float(bag[k]) for k in range(64)]), r.w[:2], r.w)
    got = {r.id: (r.class_id, r.n_links) for r in QUERIES["d05_duplicate_classes"](spark, sf).collect()}
    assert got == brute_links(items)
    assert F is not None


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(k, k + 1) for k in range(100, 140)] + [(5, 5)]
    root = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(len(root)):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = graph.components(spark.createDataFrame(edges, "a int, b int"))
    assert {r.node: r.component for r in got.collect()} == root
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


# ---- mirrors


def brute_mirrors(rows):
    out, mirrors = {}, set()
    for i, source, content, loose, url, canonical in sorted(rows):
        earlier = [r for r in sorted(rows) if r[0] < i and r[0] not in mirrors]
        for name, hit in (("content", lambda r: content is not None and r[2] == content), ("loose", lambda r: loose is not None and r[3] == loose), ("canonical", lambda r: canonical is not None and r[4] == canonical)):
            first = next((r for r in earlier if hit(r)), None)
            if first:
                if first[1] != source:
                    mirrors.add(i)
                    out[i] = first[0], name
                break
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mirrors_in_time(spark, seed):
    """Chains of declared addresses, ties between signals, same sources, mirrors as would-be originals, a document's own url."""
    rng = random.Random(seed)
    pick = lambda n, p: None if rng.random() < p else rng.randrange(n)
    rows = [(i, f"s{rng.randrange(3)}", pick(25, 0.3), pick(20, 0.3), f"u{i // 2 if rng.random() < 0.2 else i}", None if rng.random() < 0.4 else f"u{rng.randrange(max(1, i - 4), i + 2)}") for i in range(70)]
    rows = [(i, s, c and f"c{c}", l and f"l{l}", u, k) for i, s, c, l, u, k in rows]
    docs = spark.createDataFrame(rows, "id int, source string, content string, loose string, url string, canonical string")
    got = quality.linked_mirrors(docs, "id", "source", ["content", "loose"], "url", "canonical")
    assert {r.id: (r.mirror_of, r.signal) for r in got.collect()} == brute_mirrors(rows)


# ---- reachability


def test_reachability_of_pairs(spark):
    """Cycles, diamonds, unknown nodes, a node and itself, repeated pairs."""
    rng = random.Random(9)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(55)] + [(k, k + 1) for k in range(50, 60)] + [(60, 50)] + [(k, 70) for k in range(71, 110)]
    pairs = [(rng.randrange(42), rng.randrange(42)) for _ in range(60)] + [(58, 52), (70, 80), (80, 70), (5, 5), (999, 3), (999, 999), (58, 52)]
    ahead = defaultdict(set)
    for a, b in edges:
        ahead[a].add(b)

    def depends(target, start):
        todo, seen = [target], {target}
        while todo:
            for n in ahead[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        return start in seen

    got = graph.reachable(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame(pairs, "start int, target int")).collect()
    assert sorted(map(tuple, got)) == sorted({(s, t, depends(t, s)) for s, t in pairs})


# ---- as of


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("bucket", [1, 10, 10_000])
def test_as_of(spark, strict, bucket):
    """Ties, no predecessor, a hot key over many buckets, null times and keys, repeated rows."""
    rng = random.Random(bucket)
    start = datetime(2024, 1, 1)
    moment = lambda: None if rng.random() < 0.05 else start + timedelta(seconds=rng.randrange(120))
    name = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    rows = [(k, name(), moment(), "x") for k in range(80)] + [(7, "hot", start, "x")] * 2
    history = [(name(), moment(), k, rng.choice(["p", "q", None])) for k in range(40)]
    a = spark.createDataFrame(rows, "k int, key string, at timestamp, more string")
    b = spark.createDataFrame(history, "key string, at timestamp, n int, v string")
    got = temporal.as_of(a, b, ["key"], "at", ["n", "v"], "n", bucket_seconds=bucket, strict=strict)
    assert got.columns == ["k", "key", "at", "more", "n", "v"]
    want = []
    for k, g, t, x in rows:
        old = [(u, n, v) for h, u, n, v in history if None not in (g, t, u) and h == g and (u < t or (u == t and not strict))]
        best = max(old, key=lambda r: r[:2], default=(None, None, None))
        want.append((k, g, t, x, best[1], best[2]))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    with pytest.raises(ValueError):
        temporal.as_of(a, a, ["key"], "at", ["more"], "k")


# ---- automaton


@pytest.mark.parametrize("block", [3, 50_000])
def test_automaton(spark, block):
    texts = ["the cat sat on the mat", "cathedral cat", "", None, "ééa été aa aaa", "Cat", "a\ncat_", "cat-cat"]
    phrases = ["cat", "the", "at", "aa", "été", "cat", "", None, "on the", "é"]
    docs = spark.createDataFrame([*enumerate(texts)], "d int, t string")
    asked = spark.createDataFrame([*enumerate(phrases)], "p long, f string")
    word = lambda c: c.isalnum() or c == "_"
    for whole in (False, True):
        want = []
        for (p, f), (d, t) in itertools.product(enumerate(phrases), enumerate(texts)):
            at = [k for k in range(len(t)) if t.startswith(f, k)] if f and t else []
            if whole:
                at = [k for k in at if not (k and word(t[k - 1]) and word(t[k])) and not (k + len(f) < len(t) and word(t[k + len(f)]) and word(f[-1]))]
            if at:
                want.append((p, d, at[0], len(at)))
        assert sorted(map(tuple, automaton.found(docs, "d", "t", asked, "p", "f", whole, block).collect())) == sorted(want)
    assert automaton.found(docs, "d", "t", asked.limit(0), "p", "f").count() == 0
