import itertools
import math
import random
import re
from collections import Counter

from evidex.llm import urls as U


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def slow_rule(host, path):
    fits = [(len(d + p), d + p, v) for v, d, p in U.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_rules(spark):
    urls = [None, "", "x", "http://", "HTTP://A.Example.COM/en/7?x#y", "http://example.com/en/8", "http://com/en/", "http://xcom/en/", "http://a.net/de/8", "http://example.net/de/8", "http://a.example.net/de/81", "http://o.org/es/#", "http://o.org/es", "http://o.org?/es/", "a://b://c.com/en/", "http://é.com/en/x", "http://x.com#/en/", "http://Éa.org/es/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls + urls[4:6])], "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS n", "3 AS words")
    got = {r.page_id: r for r in U.judged(pages).collect()}
    assert len(got) == len(urls) + 2
    for i, u in enumerate(urls):
        host, path = slow_parts(u)
        rule, verdict = slow_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (verdict or "allow")


def test_each_rule_has_its_verdict(spark):
    """The contract's words, written out: the operator's own list is not read."""
    want = {
        "http://com/en/x": ("com/en/", "block"),
        "http://a.example.org.com/en/": ("com/en/", "block"),
        "http://example.com/en/7": ("example.com/en/7", "allow"),
        "http://www.example.com/en/71?x": ("example.com/en/7", "allow"),
        "http://example.com/en/8": ("com/en/", "block"),
        "http://net/de/": ("net/de/", "allow"),
        "http://casino.poker.net/de/casino": ("net/de/", "allow"),
        "http://example.net/de/7": ("net/de/", "allow"),
        "http://a.example.net/de/8": ("example.net/de/8", "block"),
        "http://b.org/es/1#f": ("org/es/", "block"),
    }
    pages = spark.createDataFrame([*enumerate(want)], "page_id long, url string").selectExpr("*", "CAST(NULL AS string) AS html")
    got = {r.page_id: (r.rule, r.verdict) for r in U.judged(pages).collect()}
    assert [got[i] for i in range(len(want))] == [*want.values()]


def test_viterbi_is_the_best_split():
    rng = random.Random(2)
    for _ in range(60):
        name = "".join(rng.choices("ab", k=rng.randrange(1, 9)))
        counts = {"".join(rng.choices("ab", k=rng.randrange(2, 5))): rng.randrange(1, 90) for _ in range(6)}

        def value(words):
            return sum(math.log(counts[w] / 1000) if w in counts else -math.log(1010) - 2.5 * len(w) for w in words)

        cuts = [[name[a:b] for a, b in itertools.pairwise([0, *c, len(name)])] for n in range(len(name)) for c in itertools.combinations(range(1, len(name)), n)]
        assert math.isclose(value(U.split_name(name, counts, 1000)), max(map(value, cuts)))


def test_segments_and_scores(spark):
    text = "<p>" + "cheap pills win casino garden news daily the " * 30 + "</p><script>var cheappills</script>"
    hosts = ["cheappills.org", "pillscheap.org", "casinowin.net", "winpills.org", "gardennews.org", "dailynews.org", "newsdaily.net", "thegarden.org"]
    rows = [(i, f"http://{h}/fr/{n}", text) for i, (h, n) in enumerate(itertools.product(hosts, range(5)))]
    got = U.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    assert {r.host: list(r.words)[:2] for r in got}["gardennews.org"] == ["garden", "news"]
    verdicts = {r.host: r.verdict for r in got}
    assert [verdicts[h] for h in hosts] == ["block"] * 4 + ["allow"] * 4


def slow_odds(rows, seeds=U.SEEDS):
    """Log odds per page by multinomial naive Bayes over the query's own words."""
    named = set(U.named_by())
    a, b, pages = Counter(), Counter(), [0, 0]
    for r in rows:
        assert not named & set(r.words)
        _, given = slow_rule(r.host, r.path)
        bad = given == "block" if given else bool(set(r.words) & set(seeds))
        pages[bad] += 1
        (b if bad else a).update(r.words)
    v = len({*a, *b})
    score = lambda w: math.log((b[w] + 1) / (b.total() + v)) - math.log((a[w] + 1) / (a.total() + v))
    return [math.log(pages[1] / pages[0]) + sum(map(score, r.words)) for r in rows]


def test_given_pages_against_plain_naive_bayes(spark):
    rows = U.judged(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).collect()
    for r, odds in zip(rows, slow_odds(rows)):
        assert math.isclose(r.log_odds, odds, rel_tol=1e-6, abs_tol=1e-6), r
        rule, verdict = slow_rule(r.host, r.path)
        assert (r.rule, r.verdict) == (rule, verdict or ("block" if odds > 0 else "allow"))


def test_learns_from_the_rules_verdicts(spark):
    """Words that go with blocked urls block urls without a rule; no seed is involved."""
    rows = [(i, f"http://{h}.example.net/{p}", "<p>lantern market harbor river</p>") for i, (h, p) in enumerate([*[("lanternmarket", "de/8/x")] * 20, *[("harborriver", "en/1/y")] * 30, ("lanternmarket", "fr/2/x"), ("harborriver", "fr/2/y")])]
    got = {r.page_id: r for r in U.judged(spark.createDataFrame(rows * 2, "page_id long, url string, html string")).collect()}
    assert [got[i].rule for i in (0, 50, 51)] == ["example.net/de/8", None, None]
    assert [got[i].verdict for i in (0, 20, 50, 51)] == ["block", "allow", "block", "allow"]


def test_very_long_url(spark):
    pages = spark.createDataFrame([(1, "http://" + "ab" * 3000 + ".org/es/" + "word/" * 50_000, None), (2, None, "x" * 2_000_000)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.verdict, len(r.path)) for r in U.judged(pages).collect()) == [(1, "block", 250_004), (2, "allow", 0)]


def test_empty(spark):
    assert U.judged(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_hostile_pages_take_their_length(spark):
    """Open brackets and unclosed scripts by the hundred thousand."""
    import time

    pages = ["<" * 400_000 + "word", "<script>" * 100_000, "<style x" * 100_000 + " left", "a<script>gone", "<b>kept</b> <p kept2", "&" * 300_000 + "amp;tail"]
    rows = spark.createDataFrame([(i, "http://a.com/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    start = time.perf_counter()
    got = {r.word for r in U.word_counts(rows).collect()}
    assert time.perf_counter() - start < 30
    assert {"kept", "word", "tail"} <= got and "gone" not in got
