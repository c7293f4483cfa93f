import hashlib
import random
import re

import pytest
from evidex.functions import chunking, text as X
from pyspark.sql import functions as F


def values(spark, rows, **columns):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *(c.alias(n) for n, c in columns.items())).orderBy("i").collect()]


def test_normalized(spark):
    cases = ["  a \t b \r\nc\r\rd\n\n\n\ne  ", "", "x", "\n\n", "é\tü  \n z"]
    want = ["a b\nc\n\nd\n\ne", "", "x", "", "é ü\n z"]
    assert [v[0] for v in values(spark, cases, n=X.normalized("t"))] == want


def test_fingerprint_ignores_case_and_marks_and_spares_texts_without_letters(spark):
    got = [v[0] for v in values(spark, ["Ab, c!", "abc", "日本", None], f=X.fingerprint("t"))]
    assert got[0] == got[1] == hashlib.sha256(b"abc").hexdigest() and got[2:] == [None, None]


def test_canonical_url(spark):
    cases = {"HTTP://A.com": "http://a.com/", "https://a.com/P?b=1&utm_x=2&a=3&ref=q#f": "https://a.com/P?b=1&a=3", "ftp://a/b": "", "nothing": "", "http://a.com/?fbclid=1": "http://a.com/", "http://a.com/x/?q": "http://a.com/x/?q"}
    assert [v[0] for v in values(spark, list(cases), u=X.canonical_url("t"))] == list(cases.values())
    assert values(spark, ["http://WWW.a.com/X/?q"], k=X.url_key("t"), h=X.bare_host("t")) == [("www.a.com/x", "a.com")]


def test_canonical_link(spark):
    pages = ['<link href="http://A.com/x#y" rel="canonical"><meta property="og:url" content="http://b.com">', "<meta content='http://b.com/?utm_a=1' property='og:url'>", "<link rel=stylesheet href=http://c.com>", None]
    assert [v[0] for v in values(spark, pages, c=X.canonical_link("t"))] == ["http://a.com/x", "http://b.com/", None, None]


def test_scope(spark):
    cases = ["http://a.com/docs/x", "http://b.com/docs/x", "http://a.com/docs/private", "http://a.com/blog"]
    assert [v[0] for v in values(spark, cases, s=X.in_scope("t", F.lit("a.com"), "private", None, "/docs/"))] == [True, False, False, False]
    assert [v[0] for v in values(spark, cases, s=X.in_scope("t", F.lit("a.com"), "private", "blog", "/docs/"))] == [False, False, False, True]


def test_predicate_core(spark):
    core, negated = X.predicate_core("t")
    cases = {"does not support": ("support", True), "supports": ("support", False), "is not": ("is", True), "carries over": ("carry over", False), "passes": ("pass", False), "can use": ("use", False), "Never limited to.": ("limit to", True)}
    assert values(spark, list(cases), c=core, n=negated) == list(cases.values())


def test_boilerplate(spark):
    cases = ["", " \n ", "one line", "\n".join(["short"] * 8), "\n".join(["short"] * 8 + ["x" * 50] * 3), None]
    assert [v[0] for v in values(spark, cases, b=X.boilerplate("t"))] == [True, True, False, True, False, None]


def test_sections_follow_headings():
    text = "intro\n# A\na text\n## B\n### C\nc text\n# D\nd"
    found = [(p, text[a:b]) for p, a, b in chunking.sections(text)]
    assert found == [([], "intro"), (["A"], "a text"), (["A", "B", "C"], "c text"), (["D"], "d")]


@pytest.mark.parametrize("seed", range(5))
def test_chunks_cover_and_fit(seed):
    rng = random.Random(seed)
    words = lambda n: " ".join(rng.choice(["alpha", "beta.", "gamma!", "delta"]) for _ in range(n))
    text = "\n\n".join(rng.choice(["# H", "## I", words(rng.randrange(1, 300))]) for _ in range(20))
    got = chunking.chunks(text, 500, 200)
    assert all(len(c.text) <= 500 + 200 + 2 for c in got)  # a small chunk takes in a whole piece
    assert all(text[c.start : c.start + 20].startswith(c.text[: min(20, len(c.text.split("\n\n")[0]))][:15]) for c in got)
    kept = "".join(re.findall(r"\w+", " ".join(c.text for c in got)))
    body = re.sub(r"^#+ .*$", "", text, flags=re.M)
    lost = len("".join(re.findall(r"\w+", body))) - len(kept)
    assert 0 <= lost <= 40 * 20


def test_small_chunks_take_in_what_lies_under_their_next_parent():
    small, long = "tiny text", "long text " * 40
    joined = lambda text: [(c.index, c.heading_path, c.text) for c in chunking.chunks(text, 2000, 200)]
    # Previous [A, B], next [C]: the next one's parent is the root, under which everything lies.
    assert joined(f"# A\n## B\n{small}\n# C\n{long}") == [(0, ["A", "B"], f"{small}\n\n{long.strip()}")]
    assert joined(f"# A\n{small}\n## B\n{long}") == [(0, ["A"], f"{small}\n\n{long.strip()}")]
    assert joined(f"# A\n{small}\n# B\n## C\n{long}") == [(1, ["B", "C"], long.strip())]


def test_chunk_hash_ignores_white_space():
    a, b = chunking.Chunk(0, ["H"], "x  y\nz", 0, 5), chunking.Chunk(3, ["H"], "x y z", 9, 14)
    assert a.hash == b.hash == hashlib.sha256(b"H\nx y z").hexdigest() != chunking.Chunk(0, [], "x y z", 0, 5).hash


def test_chunked_frame(spark):
    docs = spark.createDataFrame([(1, "# A\n" + "word " * 100), (2, None), (3, "tiny")], "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS start")
    rows = chunking.chunked(docs).collect()
    assert [(r["doc_id"], r["index"], r["heading_path"]) for r in rows] == [(1, 0, ["A"])]


def test_passages_against_a_plain_search(spark):
    """Windows around each mention, no more than three, none within another; the beginning where nothing is mentioned."""
    import random

    from evidex.functions import quotes
    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [(" ".join(rng.choice(["Alpha", "beta", "gamma delta", "x"]) for _ in range(rng.randint(0, 60))), rng.sample(["alpha", "BETA", "", "none", "delta x"], 2)) for _ in range(60)]

    def plain(text, words, window, most):
        out = []
        for w in (w.lower().strip() for w in words):
            at = [k for k in range(len(text)) if w and text.lower().startswith(w, k)]
            last = -1
            for k in at:
                if k < last or len(out) >= most:
                    continue
                last = k + len(w)
                piece = text[max(0, k - window // 2) : k + window // 2].strip()
                if piece and not any(piece in o or o in piece for o in out):
                    out.append(piece)
        return out or [text[:window]]

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, w array<string>")
    for window, most in ((900, 3), (40, 3), (20, 2)):
        got = {r.i: r.p for r in df.select("i", quotes.passages(F.col("t"), F.col("w"), window, most).alias("p")).collect()}
        assert got == {i: plain(t, w, window, most) for i, (t, w) in enumerate(rows)}


def test_hostile_pages_take_their_length(spark):
    """Openings without ends by the hundred thousand; what is well formed beside them stays."""
    import time

    from evidex.functions import text as X

    pages = ["<" * 400_000, "<article>" * 50_000, "<!--" * 100_000, "<nav " * 100_000, "</article>" + "<article>" * 50_000, "<script>" * 50_000, "<body " * 50_000 + ">x", "a" + " " * 300_000 + "b", "<p>kept</p><!-- gone <p>gone</p>", "<p>kept</p><nav>gone", "<article><p>in</p></article><p>out</p>"]
    df = spark.createDataFrame([*enumerate(pages)], "i int, h string")
    start = time.perf_counter()
    got = {r.i: r.t for r in df.select("i", X.main_text("h").alias("t")).collect()}
    assert time.perf_counter() - start < 60
    assert got[7] == "a b" and got[8] == got[9] == "kept" and got[10] == "in"
