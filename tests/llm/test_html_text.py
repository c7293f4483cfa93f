import html
import random
import re
import time

import xxhash
from evidex.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="home comments-open">
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></ul></nav><!-- ad --><div class="ad top">Buy</div>
<div class="cookie-notice">We use cookies</div><article><h1>A &amp;amp; B</h1><p><b>One.<br><p>Two&nbsp;  three
four<div class="share">Share this</div><form>Name <input></form><aside>See also</aside><ul><li>x<li>y</ul><table><tr><td>c1<td>c2</table>
<p hidden>no</p><section class="comments"><article class="comment">Nice!</article></section></article><div id="sidebar">Side</div><footer>&copy; us</footer></body></html>"""


def text(page):
    return "\n".join(t for t, place in H.blocks(page) if place == "main")


def test_structure():
    assert text(PAGE) == "A &amp; B\nOne.\nTwo three four\nx\ny\nc1\nc2"
    assert text('<nav>menu<main>kept</main></nav><div class="content sidebar-left"><article>also</article></div>') == "kept\nalso"
    assert text('<article><header class="entry-header"><h1>Title</h1></header><div class="post-header">By us</div><div class="entry-footer">Tags</div>Body</article>') == "Title\nBy us\nBody"
    assert text("<article>a < b &lt; c <unclosed") == "a < b < c <unclosed"
    assert H.blocks("") == [] and H.blocks("<!-- open") == [] and H.blocks("<p 'x>y") == [("y", "open")]
    assert text("<article>" + "<p>word" * 50000) == "\n".join(["word"] * 50000)


def test_suffix_array():
    rng = random.Random(1)
    tokens = [rng.randrange(3) for _ in range(200)]
    import numpy as np

    for depth in (1, 2, 3, 5, 6, 8):
        order, same = H.suffix_array(np.array(tokens + [-1]), depth)
        keys = [tuple((tokens + [-1])[i : i + depth]) for i in order]
        assert keys == sorted(keys) or sorted(set(keys)) == sorted(dict.fromkeys(keys))
        assert [bool(s) for s in same] == [False] + [a == b for a, b in zip(keys, keys[1:])]
        assert len(dict.fromkeys(keys)) == len([s for s in same if not s])


def test_host_repeats_without_landmarks(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(2000)]

    def prose():
        return " ".join(rng.choices(words, k=60))

    top, low = "Welcome to our site please look around here", "Copyright the site owner all rights are reserved now"
    rows, want = [], {}
    for i in range(60):
        a, b = prose(), prose()
        rows.append((i, "http://hot.example/x", f"<div>{top}</div><div>{a}</div><p>Short line</p><div>{b}</div><div>{low}</div>"))
        want[i] = f"{a}\n{b}"
    own = prose()
    rows += [(100, "http://one.example", f"<div>{own}</div>"), (101, None, f"<div>{own}</div>"), (102, "x", None), (103, "x", " "), (104, "http://hot.example", "<article>Hi</article>")]
    copy = "".join(f"<div>{prose()}</div>" for _ in range(3))
    rows += [(i, "http://copies.example", copy) for i in range(200, 205)]
    want |= {100: own, 101: own, 102: "", 103: "", 104: "Hi"} | {i: copy.replace("</div><div>", "\n")[5:-6] for i in range(200, 205)}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS id", "2 AS row", "3 AS host", "4 AS text")
    for shard in (10**6, 4000):
        got = H.main_text(pages, shard_bytes=shard).collect()
        assert {r.page_id: r.text for r in got} == want and len(got) == len(rows)
        assert all(r.n_chars == len(r.text) for r in got)


def test_hostile_pages_take_time_in_proportion():
    n = 40_000
    pages = ["<a " * n, '<a "' * n, "<b></i>" * n, "<div>" * n + "</section>" * n, "<p><div>" + "<b>" * n + "<h1></h1>" * n, "<!" * n, "<?" * n, "&" * n, "<a x='" * n + ">", "<ul>" + "<li>" * n, "<a " + "x = " * n + ">t", "<" * n, "</" * n]
    for page in pages:
        begin = time.perf_counter()
        H.blocks(page)
        assert time.perf_counter() - begin < 1, page[:20]


def slow_text(pages, shard_bytes, window=6, least=H.LEAST):
    """{page id: text} by counting windows in dictionaries, a host at a time."""
    hosts, out = {}, {}
    for i, u, h in pages:
        hosts.setdefault(H.host_of(u), []).append((i, H.blocks(h or "")))

    def windows(text):
        words = text.lower().split()
        return [tuple(words[a : a + window]) for a in range(max(1, len(words) - window + 1))]

    for rows in hosts.values():
        shards = -(-sum(64 + sum(len(t) for t, _ in found) for _, found in rows) // shard_bytes)
        copies, seen = [], {}
        for k, (_, found) in enumerate(rows):
            names = [name_of(w) for t, p in found if p != "aside" for w in windows(t)]
            copies.append(min(names) if names else -1 - k)
        for k, (_, found) in enumerate(rows):
            for t, _ in found:
                for w in windows(t):
                    seen.setdefault(w, set()).add(copies[k])
        for i, found in rows:
            wanted = "main" if any(p == "main" for _, p in found) else "open"
            lines = []
            for t, p in found:
                if p == wanted:
                    words, gone = t.split(), set()
                    for a, w in enumerate(windows(t)):
                        if len(seen[w]) >= max(least[p][0] * shards, least[p][1] * len(rows)):
                            gone |= {*range(a, a + len(w))}
                    if line := " ".join(w for k, w in enumerate(words) if k not in gone):
                        lines.append(line)
            out.setdefault(i, []).append("\n".join(lines))
    return out


def name_of(w):
    value = 0
    for i, word in enumerate(w):
        value = ((value ^ xxhash.xxh3_64_intdigest(word)) * 0x9E3779B97F4A7C15 + i + 1) % 2**64
    return value


def site(rng, host, n, article):
    words = [f"v{rng.randrange(4000)}" for _ in range(4000)]
    prose = lambda k: " ".join(rng.choices(words, k=k))
    share, legal, quote = prose(14), prose(50), prose(30)
    out = []
    for i in range(n):
        body = f"<p>{prose(80)} {quote if i % 4 == 0 else ''} {prose(20)}</p><p>{prose(9)} {share} {prose(7)}</p>"
        page = f"<div>{legal}</div><div>{prose(5)}</div>" + (f"<article>{body}</article>" if article else body) + f"<nav>{prose(8)}</nav>"
        out += [(f"{host}{i}", f"https://{host}/p{i}", page)] * (1 + (i == 3) * 5)
    return out


def test_repeats_against_brute_force_at_any_shard_size(spark, monkeypatch):
    rng = random.Random(8)
    pages = site(rng, "a.example", 40, False) + site(rng, "b.example", 30, True) + site(rng, "c.example", 2, False) + [("n", None, None)]
    df = spark.createDataFrame(pages, "page_id string, url string, html string").repartition(7)
    for shard, sent in ((10**7, 10**6), (9_000, 10**6), (9_000, 0)):
        monkeypatch.setattr(H, "BROADCAST_REPEATS", sent)
        monkeypatch.setattr(H, "PACK_BYTES", 4_000 if shard < 10**6 else 1 << 18)
        got, want = {}, slow_text(pages, shard)
        for r in H.main_text(df, shard_bytes=shard).collect():
            got.setdefault(r.page_id, []).append(r.text)
        assert got == want
    want = slow_text(pages, 10**7)
    share = pages[0][2].split("<p>")[2].split()[9:23]
    assert not any(" ".join(share) in t for ts in want.values() for t in ts)  # cut out of every block, with unique runs left
    assert all(len(t.split("\n")[-1].split()) == 16 for i, ts in want.items() for t in ts if i[0] in "ab")


def test_empty(spark):
    assert H.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_given_pages(spark, sf):
    """The given articles, as a plain reading of their markup has them: repeats cut nothing out of them."""
    rows = H.main_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"(?s)<article>(.*)</article>", pages[r.page_id])[1]
        parts = re.split(r"</?(?:p|h1|h2|h3|div|ul|li|pre|table|tr|td|section)\b[^>]*>", article)
        plain = [" ".join(html.unescape(re.sub(r"<br[^>]*>", " ", re.sub(r"<(?!br)[^>]*>", "", x))).split()) for x in parts]
        assert r.text == "\n".join(x for x in plain if x) or "<" in "".join(plain), r.page_id
