"""Main text of web pages: a suffix array over each host's token streams, with page structure as evidence.

A page is cut into blocks, each with a place that its markup gives: in a menu, header, footer, sidebar, notice, advert,
form or comment (aside); inside <article> or <main> (main); or neither (open). Then all pages of a host are judged
together: their token streams are concatenated, a suffix array finds the substrings of `window` tokens or more that
repeat across distinct pages, and what they cover is boilerplate. It is cut out of its block, and the block's unique runs
stay. A page's text is what is left of its main blocks, or of its open ones where it marks no article.

A repeat is boilerplate in an open block if a small share of the host's pages has it, in an article only if most have it,
since articles may quote each other. Copies of one page count once: pages whose windows have the same least hash.

A host may hold a third of all pages, so its pages are dealt to shards of bounded bytes, each with its own suffix array.
A window on a share of all the host's pages is on at least that share of some shard's pages; shards name windows on half
that share, with their counts, and what these leave open is counted again in all shards, so the totals that decide are
those of the whole host. No task sees more than a shard.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import slices, staged

WINDOW_TOKENS, SHARD_BYTES, PACK_BYTES = 6, 8 << 20, 256 << 10
#: Boilerplate by place: on at least so many pages of its host for each SHARD_BYTES of their text, and on at least that
#: share of them.
LEAST = {"open": (3, 0.01), "main": (8, 0.5)}
#: Tables of up to so many hosts are sent to all tasks; more are joined by a shuffle.
BROADCAST_HOSTS = 20_000
#: Repeats (16 bytes each) that are sent to all tasks, so that pages needn't be shuffled to meet them; more are joined.
BROADCAST_REPEATS = 1_000_000
#: Element names by their role in HTML.
BLOCK = frozenset("address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
DROP = frozenset("nav footer aside form button select svg canvas object audio video dialog menu head math map datalist".split())
#: Words in class, id and role that mark what is not the article.
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs masthead topbar toolbar header footer contentinfo sidebar complementary widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay dialog newsletter subscribe subscription signup login share sharing social search pagination pager paywall skip".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion related recommended teaser".split())
WHOLE = frozenset("html body main".split())
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPLIT = re.compile(r"[^a-z0-9]+")
CLOSES_P = BLOCK - {"body", "html", "head", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "optgroup", "option", "summary"}
#: Elements that end when a sibling of the kind begins, and where the search for it stops.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HOLDERS = frozenset("article aside blockquote body button dd div figure footer form header li main nav section table td th".split())


def _reason(tag: str, attributes: str, in_main: bool) -> str:
    """Why an element is not the article: 'tag', 'aside', 'comment' or ''."""
    if tag in DROP:
        return "tag"
    if tag == "header" and not in_main:
        return "aside"
    if tag in WHOLE or not attributes:
        return ""
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return "tag"
    words = set(SPLIT.split(" ".join(found.get(k, "") for k in ("class", "id", "role")).lower()))
    if words & COMMENT_WORDS:
        return "comment"
    if in_main:
        words -= {"header"}  # an article's own head holds its title
    return "aside" if words & ASIDE_WORDS and tag != "article" else ""


def blocks(page: str) -> list[tuple[str, str]]:
    """(text, place) in page order; place is main, open or aside. Time in proportion to the page, whatever it holds."""
    out: list[tuple[str, str]] = []
    text: list[str] = []
    stack: list[tuple[str, str, bool]] = [("", "", False)]  # element, why it is dropped, inside article or main
    where: dict[str, list[int]] = {}  # the places in the stack of each element's name

    def end() -> None:
        if text:
            words = " ".join("".join(text).split())
            if words:
                _, why, main = stack[-1]
                out.append((words, "aside" if why else "main" if main else "open"))
            text.clear()

    def say(piece: str) -> None:
        if piece:
            text.append(html_lib.unescape(piece) if "&" in piece else piece)

    def pop(names: set[str], stop: frozenset[str] | set[str]) -> None:
        """Ends the innermost open element of these names, and all inside it, unless one of `stop` is further in."""
        at = max((where[n][-1] for n in names if where.get(n)), default=0)
        if at and at > max((where[n][-1] for n in stop - names if where.get(n)), default=0):
            for name, *_ in stack[at:]:
                where[name].pop()
            del stack[at:]

    at, size, last = 0, len(page), page.rfind(">")
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            say(page[at:])
            break
        say(page[at:begin])
        mark = page[begin + 1 : begin + 2]
        if page.startswith("<!--", begin):
            close = page.find("-->", begin + 4)
            at = close + 3 if close >= 0 else size
            continue
        if begin > last:  # no tag ends any more
            say(page[begin:])
            break
        if mark in ("!", "?"):
            at = page.find(">", begin) + 1
            continue
        m = TAG.match(page, begin)
        if not m:
            say("<")
            at = begin + 1
            continue
        at = m.end()
        tag = (m[2] or m[5]).lower()
        if m[1] or m[4]:
            if tag in BLOCK:
                end()
            pop({tag}, HOLDERS if tag not in BLOCK else frozenset())
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCK:
            end()
            if tag in CLOSES_P:
                pop({"p"}, HOLDERS)
            if tag in SIBLINGS:
                pop(*SIBLINGS[tag])
        if tag in VOID:
            continue
        _, why, main = stack[-1]
        attributes = m[3] or m[6] or ""
        own = _reason(tag, attributes, main)
        landmark = tag in ("article", "main") or 'role="main"' in attributes
        if landmark and own != "comment":
            why, main = (why if why == "comment" else ""), True
            own = ""
        if not attributes.endswith("/"):
            where.setdefault(tag, []).append(len(stack))
            stack.append((tag, why or own, main and not (why or own)))
    end()
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"[^:]*://([^/?#]*)", url or "")
    return m[1].lower() if m else ""


PLACES = ("aside", "open", "main")


def _packs(pages: DataFrame, id: str, url: str, body: str) -> DataFrame:
    """(host, pack, pages, bytes, data): pages as packs of one host each; data holds their ids, urls, and blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, total = TaskContext.get().partitionId() << 32, {}, 0

        def packed(host: str) -> tuple:
            nonlocal number, total
            ids, urls, texts, places, size = held.pop(host)
            total -= size
            number += 1
            rows = pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(urls, pa.string()), pa.array(texts, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int8()))], ["id", "url", "texts", "places"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 7))) as out:
                out.write_batch(rows)
            return host, number, len(ids), size, sink.getvalue().to_pybytes()

        def emitted(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["host", "pack", "pages", "bytes", "data"])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for part in slices(batch, "_body"):
                for i, u, page in zip(*(part.column(c).to_pylist() for c in ("id", "url", "_body"))):
                    found, host = blocks(page or ""), host_of(u)
                    size = 64 + sum(len(t) for t, _ in found)
                    mine = held.setdefault(host, [[], [], [], [], 0])
                    for column, value in zip(mine, (i, u, [t for t, _ in found], [PLACES.index(p) for _, p in found])):
                        column.append(value)
                    mine[4] += size
                    total += size
                    if mine[4] >= PACK_BYTES:
                        yield emitted([packed(host)])
                if total >= 32 * PACK_BYTES:
                    yield emitted([packed(h) for h in [*held]])
        for at in range(0, len(hosts := [*held]), 64):
            yield emitted([packed(h) for h in hosts[at : at + 64]])

    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.col(body).alias("_body"))
    return rows.mapInArrow(run, "host string, pack long, pages long, bytes long, data binary")


def suffix_array(tokens, depth: int):
    """(order, same): suffixes sorted by their first `depth` or more tokens, by prefix doubling; same[i]: suffix order[i]
    shares them with order[i - 1], that is, their longest common prefix reaches `depth`. Tokens are numbers; each negative
    one occurs once and so ends every match. Any longer repeat is covered by repeats of `depth` tokens in the same pages,
    so nothing needs to be sorted further."""
    import numpy as np

    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    length = 1
    while length < depth:  # ranks by `length` tokens to ranks by up to twice that
        step = min(length, depth - length)
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
        length += step
    order = np.argsort(rank, kind="stable")
    return order, np.r_[False, rank[order][1:] == rank[order][:-1]] if n else np.zeros(0, bool)


class Shard:
    """Pages of one host as one token stream, blocks apart. `starts` marks where windows begin, `size` is their length and
    `names` their hash; a block shorter than the window is a window of its own. `page` and `block` tell where tokens lie."""

    def __init__(self, data: list[bytes], window: int):
        import numpy as np
        import xxhash

        self.rows = pa.concat_tables([pa.ipc.open_stream(d).read_all() for d in data])
        self.texts, self.places = self.rows.column("texts").to_pylist(), self.rows.column("places").to_pylist()
        ids: dict[bytes, int] = {}
        tokens, sizes = [], []
        for texts in self.texts:
            for text in texts:
                words = text.lower().split()
                tokens.extend([ids.setdefault(w, len(ids)) for w in words])
                tokens.append(-1 - len(sizes))
                sizes.append(len(words) + 1)
        self.tokens, sizes = np.array(tokens, np.int64), np.array(sizes, np.int64)
        n, self.window = len(self.tokens), window
        self.begin = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        self.block = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.repeat(np.array([p for ps in self.places for p in ps], np.int8), sizes)
        self.page = np.repeat(np.repeat(np.arange(len(self.texts)), [len(t) for t in self.texts]), sizes)
        left = self.begin[self.block + 1] - 1 - np.arange(n)
        first = self.begin[self.block] == np.arange(n)
        self.starts = (left >= window) | (first & (left > 0))
        self.size = np.minimum(left, window)
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in ids] or [0], np.uint64)
        names = np.zeros(n, np.uint64)
        for i in range(window):
            word = hashes[np.maximum(self.tokens[np.minimum(np.arange(n) + i, max(0, n - 1))], 0)]
            names = np.where(self.size > i, (names ^ word) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1), names)
        self.names = names.view(np.int64)
        # Copies of a page share the least hash of their windows, asides left out, and count as one page.
        self.copy = np.arange(len(self.texts)) - len(self.texts)
        mine = np.flatnonzero(self.starts & (self.place > 0))
        if len(mine):
            lead = np.flatnonzero(np.r_[True, np.diff(self.page[mine]) != 0])
            self.copy[self.page[mine][lead]] = np.minimum.reduceat(names[mine], lead).view(np.int64)

    def _counted(self, keys, at):
        """(distinct keys, distinct pages of each) of windows at `at`."""
        import numpy as np

        copies = np.unique(self.copy, return_inverse=True)[1]
        order = np.lexsort((copies[self.page[at]], keys))
        k, c = keys[order], copies[self.page[at]][order]
        new = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])] if len(k) else np.zeros(0, bool)
        return np.unique(k[new], return_counts=True)

    def repeats(self, least: float):
        """(names, distinct pages) of the windows on at least `least` pages, from the suffix array."""
        import numpy as np

        order, same = suffix_array(self.tokens, self.window)
        picked = self.starts[order] & (self.size[order] == self.window)
        at, group = order[picked], np.cumsum(~same)[picked]  # neighbours that share a window are a group
        _, count = self._counted(group, at)
        names = self.names[at[np.unique(group, return_index=True)[1]]]
        short, more = self._counted(self.names[whole], whole) if len(whole := np.flatnonzero(self.starts & (self.size < self.window))) else (names[:0], count[:0])
        names, count = np.r_[names, short], np.r_[count, more]
        return names[count >= least], count[count >= least]

    def counts(self, names):
        """(names, distinct pages) of given windows."""
        import numpy as np

        at = np.flatnonzero(self.starts & np.isin(self.names, names))
        return self._counted(self.names[at], at)

    def kept(self, names, totals, pages: int, shards: int, least: dict) -> pa.Table:
        """(id, url, text) per page, without what repeats on enough of the host's `pages` cover."""
        import numpy as np

        cut = np.zeros(len(self.tokens), bool)
        for place, (fewest, share) in least.items():
            hit = np.flatnonzero(self.starts & (self.place == PLACES.index(place)) & np.isin(self.names, names[totals >= max(fewest * shards, share * pages)]))
            step = np.zeros(len(self.tokens) + 1, np.int64)
            np.add.at(step, hit, 1)
            np.add.at(step, hit + self.size[hit], -1)
            cut |= np.cumsum(step)[:-1] > 0
        touched = {int(b) for b in np.unique(self.block[cut])}
        out, b = [], 0
        for texts, places in zip(self.texts, self.places):
            wanted = max(places, default=0)
            lines = []
            for text, place in zip(texts, places):
                if place and place == wanted:
                    if b in touched:
                        gone = cut[self.begin[b] : self.begin[b + 1] - 1]
                        text = " ".join([w for w, g in zip(text.split(), gone) if not g])
                    if text:
                        lines.append(text)
                b += 1
            out.append("\n".join(lines))
        return pa.table({"id": self.rows.column("id"), "url": self.rows.column("url"), "text": pa.array(out, pa.string())})


def main_text(pages: DataFrame, id: str = "page_id", url: str = "url", body: str = "html", window: int = WINDOW_TOKENS, least: dict = LEAST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, url, text, n_chars) per page.

    Null and blank pages have an empty text. Pages without a url share the empty host. Repeated rows are copies of one
    page. A block shorter than the window counts as one whole; an empty table gives an empty result.
    """
    packs = staged(_packs(pages, id, url, body), "packs")
    hosts = staged(packs.groupBy("host").agg(F.sum("pages").alias("all_pages"), F.greatest(F.ceil(F.sum("bytes") / shard_bytes), F.lit(1)).cast("long").alias("n")), "hosts")
    few = hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    dealt = packs.join(F.broadcast(hosts) if few else hosts, "host").select("host", "all_pages", "n", F.pmod(F.xxhash64("pack"), F.col("n")).alias("shard"), "data")
    kind = pages.schema[id].dataType.simpleString()
    result = f"id {kind}, url string, text string"
    fewest, share = least["open"]

    def opened(table: pa.Table) -> tuple[Shard, int, int]:
        """The shard, and the pages and shards of its host."""
        return Shard(table.column("data").to_pylist(), window), table.column("all_pages")[0].as_py(), table.column("n")[0].as_py()

    def alone(table: pa.Table) -> pa.Table:
        shard, n, _ = opened(table)
        return shard.kept(*shard.repeats(max(fewest, share * n)), n, 1, least)

    def nominated(key: tuple, table: pa.Table) -> pa.Table:
        shard, n, parts = opened(table)
        names, counts = shard.repeats(max(fewest * parts, share * n) * len(shard.texts) / n / 2)
        return pa.table({"host": pa.array([key[0].as_py()] * len(names), pa.string()), "name": pa.array(names), "pages": pa.array(counts, pa.int64()), "of": pa.array([len(shard.texts)] * len(names), pa.int64())})

    def told(key: tuple, table: pa.Table, asked: pa.Table) -> pa.Table:
        names, counts = Shard(table.column("data").to_pylist(), window).counts(asked.column("name").to_numpy()) if table.num_rows and asked.num_rows else ([], [])
        return pa.table({"host": pa.array([key[0].as_py()] * len(names), pa.string()), "name": pa.array(names, pa.int64()), "total": pa.array(counts, pa.int64())})

    id_type = to_arrow_type(pages.schema[id].dataType)
    one, more = dealt.filter("n = 1").groupBy("host"), dealt.filter("n > 1")
    shards = hosts.filter("n > 1").select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("shard"))
    # A shard names windows on half the share that counts. What all shards that named a window saw of it may be enough, or
    # may leave too little to the others; only windows in between are counted again in all shards.
    seen = more.groupBy("host", "shard").applyInArrow(nominated, "host string, name long, pages long, of long")
    seen = seen.groupBy("host", "name").agg(F.sum("pages").alias("total"), F.sum("of").alias("of")).join(hosts.select("host", "all_pages", "n"), "host")
    wanted = F.greatest(F.lit(float(fewest)) * F.col("n"), share * F.col("all_pages"))
    seen = staged(seen.withColumn("wanted", wanted).filter(F.col("total") + F.col("wanted") / 2 * (1 - F.col("of") / F.col("all_pages")) >= F.col("wanted")), "nominees")
    # Above this total nothing that a place asks for can still differ.
    most = F.greatest(*(F.greatest(F.lit(float(a)) * F.col("n"), b * F.col("all_pages")) for a, b in least.values()))
    sure = (F.col("of") >= F.col("all_pages")) | (F.col("total") >= most)
    open_ = staged(seen.filter(~sure).select("host", "name"), "asked")
    often = seen.filter(sure).select("host", "name", "total", "wanted")
    if not open_.isEmpty():
        again = more.join(open_.select("host").distinct(), "host", "left_semi").groupBy("host", "shard")
        asked = open_.join(shards, "host")
        counts = again.cogroup(asked.groupBy("host", "shard")).applyInArrow(told, "host string, name long, total long")
        often = often.union(counts.groupBy("host", "name").agg(F.sum("total").alias("total")).join(seen.select("host", "name", "wanted"), ["host", "name"]).select("host", "name", "total", "wanted"))
    often = staged(often.filter("total >= wanted").select("host", "name", "total"), "repeats")

    def cleared(table: pa.Table, repeats: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"id": pa.array([], id_type), "url": pa.array([], pa.string()), "text": pa.array([], pa.string())})
        shard, n, parts = opened(table)
        return shard.kept(repeats.column("name").to_numpy(), repeats.column("total").to_numpy(), n, parts, least)

    if often.limit(BROADCAST_REPEATS + 1).count() <= BROADCAST_REPEATS:
        send = pages.sparkSession.sparkContext.broadcast(_by_host(often))

        def packwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            none = np.zeros(0, np.int64)
            for batch in batches:
                for host, n, parts, data in zip(*(batch.column(c).to_pylist() for c in ("host", "all_pages", "n")), batch.column("data")):
                    names, totals = send.value.get(host, (none, none))
                    yield from Shard([data.as_py()], window).kept(names, totals, n, parts, least).to_batches()

        rest = more.select("host", "all_pages", "n", "data").mapInArrow(packwise, result)
    else:
        rest = more.groupBy("host", "shard").cogroup(often.join(shards, "host").groupBy("host", "shard")).applyInArrow(cleared, result)
    parts = one.applyInArrow(alone, result).union(rest)
    return parts.select(F.col("id").alias(id), F.col("url").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"))


def _by_host(often: DataFrame) -> dict:
    """{host: (names, totals)} of a counted table."""
    import numpy as np

    rows = often.toPandas()
    return {host: (part["name"].to_numpy(np.int64), part["total"].to_numpy(np.int64)) for host, part in rows.groupby("host")}
