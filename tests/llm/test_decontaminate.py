import random
import re

from evidex.llm import decontaminate as D


def tokens(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def slow(text, items, window=10):
    words, hit, found = tokens(text), set(), set()
    for i, t in items:
        w = tokens(t)
        n = min(window, len(w))
        for a in range(len(w) - n + 1) if n else ():
            for b in range(len(words) - n + 1):
                if words[b : b + n] == w[a : a + n]:
                    hit |= {*range(b, b + n)}
                    found.add(str(i))
    return len(words), len(hit), sorted(found)


def cases():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)] + ["é", "Ünï"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 4, 9, 10, 11, 30, 60])))) for i in range(25)] + [(90, None), (91, "..."), (7, "w1 w2 w3 w4")]
    docs = [(0, None), (1, ""), (2, "Short"), (2, "Short"), (3, items[4][1] or "x")]
    for d in range(4, 60):
        words = rng.choices(vocab, k=rng.randrange(0, 200))
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").upper().split()
            a = rng.randrange(len(w) + 1)
            at = rng.randrange(len(words) + 1)
            words[at:at] = w[a : a + rng.randrange(40)]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(words)))
    return docs, items


def test_against_brute_force(spark):
    docs, items = cases()
    frame = spark.createDataFrame([(*d, "c", 1, 2) for d in docs], "doc_id long, text string, items string, n_words int, _x int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (10**6, 100):
        got = sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in D.contamination(frame, bench, ["doc_id"], block_words=most).collect())
        assert got == sorted((i, *slow(t, items)) for i, t in docs)
    left = sorted(r.doc_id for r in D.clean(frame, bench).collect())
    assert left == sorted(i for i, t in docs if not slow(t, items)[1])


def test_longest_matches(spark):
    item = "a b c d e f g h i j k l m n"
    docs = spark.createDataFrame([(1, "x y " + item + " z"), (2, "b c d e f g h i j k l q a b c"), (3, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = sorted(tuple(r) for r in D.longest_matches(docs, bench).collect())
    assert got == [(1, 5, 2, 0, 14), (2, 5, 0, 1, 11)]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(docs, bench, ["doc_id"]).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r.n_hit for r in D.contamination(one, bench, ["doc_id"]).collect()] == [0]
    assert D.longest_matches(one, bench).collect() == []


def slow_matches(text, items, window=10):
    words, out = tokens(text), set()
    for i, t in items:
        w = tokens(t)
        n = min(window, len(w))
        for a in range(len(w)):
            for b in range(len(words)):
                if n and (not a or not b or w[a - 1] != words[b - 1]) and w[a] == words[b]:
                    k = 0
                    while a + k < len(w) and b + k < len(words) and w[a + k] == words[b + k]:
                        k += 1
                    if k >= n:
                        out.add((i, b, a, k))
    return out


def test_matches_and_locations_against_brute_force(spark):
    docs, items = cases()
    frame = spark.createDataFrame([(*d, "c", 1, "m") for d in docs], "doc_id long, text string, item string, start int, matches string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, *m) for i, t in docs for m in slow_matches(t, items))
    for most in (10**6, 100):
        assert sorted(tuple(r) for r in D.longest_matches(frame, bench, block_words=most).collect()) == want
    rows = D.contamination(frame, bench, ["doc_id"]).collect()
    assert sorted((r.doc_id, int(m["item"]), m["start"], m["item_start"], m["n_words"]) for r in rows for m in r["matches"]) == want


def test_very_long_text(spark):
    item = " ".join(f"b{i}" for i in range(40))
    text = "word other " * 300_000 + item + " tail" * 300_000
    docs, bench = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")
    assert [tuple(r) for r in D.longest_matches(docs, bench).collect()] == [(1, 5, 600_000, 0, 40)]
    assert [(r.n_words, r.n_hit) for r in D.contamination(docs, bench, ["doc_id"]).collect()] == [(900_040, 40)]
