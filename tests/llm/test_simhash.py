import random
import re
from collections import Counter

import xxhash
from evidex.llm import simhash as S

SCHEMA = "doc_id long, text string, fp string, root int"


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def slow_similar(texts, words=5, least=0.8):
    """Components of all pairs of texts whose sets of shingles are similar enough."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    holders = {}
    for i, x in enumerate(sets):
        for g in x or [None]:
            holders.setdefault(g, []).append(i)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    common = Counter((j, i) for own in holders.values() for k, i in enumerate(own) for j in own[:k])
    for (j, i), n in common.items():
        if sets[i] == sets[j] or n >= least * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(sets))]


def lows(rows, roots):
    low = {}
    for r, w in zip(rows, roots):
        low[w] = min(low.get(w, r.doc_id), r.doc_id)
    return [low[w] for w in roots]


def test_simhash_of_odd_texts():
    for t in ["", None, "  \t\n", "One", "ONE two", "A b C d", "é Ünï x y \x0b z", "w " * 70000]:
        assert S.simhash(S.shingle_hashes((t or "").encode())) == slow_print(t)


def test_links_connect_all_pairs(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 6))) for b in base for _ in range(30)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    for most in (10000, 5):
        edges = S.links(df, most)
        pairs = {(r.a, r.b) for r in edges.collect()}
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 and a < b for a, b in pairs)
        got = {r.node: r.root for r in S.components(edges).collect()}
        want = slow_components(prints)
        same = {}
        for p, w in zip(signed, want):
            assert same.setdefault(got.get(p, p), w) == w
        assert len(same) == len(set(want))


def test_whole_operator(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(120)
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, " "), (1003, "x y"), (1003, "x y")], "doc_id long, text string")
    rows = docs.union(odd).collect()
    want = slow_components([slow_print(r.text) for r in rows])
    low = {}
    for r, w in zip(rows, want):
        low[w] = min(low.get(w, r.doc_id), r.doc_id)
    expected = sorted((r.doc_id, low[w]) for r, w in zip(rows, want))
    frame = docs.union(odd)
    assert sorted((r.doc_id, r.component_id) for r in S.near_duplicates(frame).collect()) == expected
    expected = sorted((r.doc_id, c) for r, c in zip(rows, lows(rows, slow_similar([r.text for r in rows]))))
    clashing = frame.selectExpr("*", "1 AS fp", "2 AS root", "3 AS a", "4 AS row", "5 AS id", "6 AS digest")
    assert sorted((r.doc_id, r.component_id) for r in S.similar(clashing).collect()) == expected
    kept = S.keep_first(clashing).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c in expected})


def test_near_copies_against_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    rows, common = [], rng.choices(words, k=40)
    for group in range(12):
        base = rng.choices(words, k=rng.randrange(30, 250)) + (common if group % 3 == 0 else [])
        for _ in range(rng.choice([1, 2, 5, 60])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy[rng.randrange(3) :])))
    rows += [(len(rows), ("tail " * 5).strip()), (len(rows) + 1, "long " * 400_000), (len(rows) + 2, "long " * 400_001)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.similar(df).collect()
    rows = df.collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((r.doc_id, c) for r, c in zip(rows, lows(rows, slow_similar([r.text for r in rows]))))


def few_links(n=150, apart=7):
    """Near copies of a text, less similar than 0.8 to each other but for a few pairs: those differ from the text in the
    same places, and by other words, so that they share no bucket but the large ones."""
    rng, rows = random.Random(3), []
    for i in range(n):
        places = rng.sample(range(10, 320), apart)
        for id in (i, 10_000 + i)[: 1 + (i % 50 == 0)]:
            rows.append((id, " ".join(f"x{id}-{k}" if k in places else f"w{k}" for k in range(330))))
    return rows


def test_few_links_in_a_large_group(spark, monkeypatch):
    """Links between texts that no bucket has as its representatives, however few those are; in one tile and in many."""
    monkeypatch.setattr(S, "HEADS", 1, raising=False)  # a former cap
    rows = few_links()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(zip((i for i, _ in rows), lows(df.collect(), slow_similar([t for _, t in rows]))))
    assert sum(i != c for i, c in want) >= 3
    for tile in (S.TILE, 20):
        monkeypatch.setattr(S, "TILE", tile)
        assert sorted((r.doc_id, r.component_id) for r in S.similar(df).collect()) == want


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert S.near_duplicates(none).collect() == [] and S.keep_first(none).collect() == []
