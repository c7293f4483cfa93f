"""Near duplicates by SimHash, with pigeonring filtering of the candidates.

A 64-bit fingerprint is a ring of 16 segments of 4 bits. If two fingerprints differ in at most 3 bits, then (strong
pigeonring) from some segment on, every chain of l consecutive segments differs in at most floor(3 l / 16) bits: none
in the first 5, one in the first 10, two in the first 15. So fingerprints are joined on (start, first 5 segments), 16
keys each, and a pair is dropped as soon as its chain leaves its budget, before the full Hamming check.

A bucket never yields all its pairs: it yields a spanning forest of its links, which is all that components need.
Buckets with more than `split_above` fingerprints are split on the next 5 segments, where one differing bit is allowed:
each fingerprint is filed under its own 20 bits and looks into the 20 places one bit away, which loses no link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, scratch
from .common import free_name, raw, schema_of, slices, staged

BITS, SEGMENT, THRESHOLD = 64, 4, 3
SEGMENTS = BITS // SEGMENT
#: Segments that a chain may cover without any differing bit, 5 here.
PREFIX = next(n for n in range(SEGMENTS, 0, -1) if n * THRESHOLD // SEGMENTS == 0)
KEY_BITS = PREFIX * SEGMENT
SPLIT_ABOVE = 4096


def shingle_hashes(text: bytes, shingle: int = 3, seed: int = 42):
    """XXH64 of a UTF-8 text's shingles, with repeats: A-Z lower-cased, words apart at ASCII white space; none without words."""
    import numpy as np
    import xxhash

    words = text.lower().split()
    n = max(min(len(words), 1), len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)] * n
    return np.fromiter((digest(s, seed) for s in shingles), np.uint64, n)


def simhash(hashes) -> int:
    """The unsigned fingerprint of shingle hashes: a bit is set if it is in over half of them."""
    import numpy as np

    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", *keep: str, shingle: int = 3, seed: int = 42) -> DataFrame:
    """`keep` columns and the fingerprint, a long with the same 64 bits. Null texts are empty: fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for part in slices(batch, text):
                fp = np.array([simhash(shingle_hashes(t, shingle, seed)) for t in raw(part, text)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(fp)], [*keep, "fp"])

    return docs.select(*keep, *({text} - {*keep})).mapInArrow(run, f"{schema_of(docs, *keep)}, fp long")


def rotated(fp: str, start: int) -> Column:
    """The ring read from segment `start`, which becomes the top bits."""
    n = start * SEGMENT
    return F.col(fp) if not n else F.shiftleft(fp, n).bitwiseOR(F.shiftrightunsigned(fp, BITS - n))


def _chains(prints: DataFrame) -> DataFrame:
    """(key, ring): each fingerprint under its 16 starts; key holds the start and the first 5 segments."""
    rows = F.explode(F.array(*(F.struct((F.lit(s << KEY_BITS) + F.shiftrightunsigned(rotated("fp", s), BITS - KEY_BITS)).alias("key"), rotated("fp", s).alias("ring")) for s in range(SEGMENTS))))
    return prints.select(rows.alias("c")).select("c.key", "c.ring")


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, start, ring) rows to links (a, b): for each key a spanning forest of the pairs within all budgets."""
    import numpy as np

    budgets = [(BITS - SEGMENT * n, n * THRESHOLD // SEGMENTS) for n in (2 * PREFIX, 3 * PREFIX, SEGMENTS)]

    def near(x: np.ndarray) -> np.ndarray:
        ok = x >> np.uint64(BITS - KEY_BITS) == 0
        for shift, most in budgets:
            ok &= np.bitwise_count(x >> np.uint64(shift)) <= most
        return ok

    def forest(ring: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left = np.unique(ring)
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                hit = near(left ^ x)
                if hit.any():
                    found, left = left[hit], left[~hit]
                    queue.extend(found)
                    yield np.full(len(found), x), found

    def out(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b, s = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.uint64) for i in range(3))
        n = (s * SEGMENT).astype(np.uint64)
        back = [np.where(n == 0, x, (x >> n) | (x << ((np.uint64(BITS) - n) % np.uint64(BITS)))).astype(np.uint64) for x in (a, b)]
        a, b = (x.view(np.int64) for x in back)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]

    def scan(key: np.ndarray, start: np.ndarray, ring: np.ndarray) -> list:
        pairs = []
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[cut, len(key)])
        small = np.repeat(sizes <= 8, sizes)
        for d in range(1, 8):
            i = np.flatnonzero((key[d:] == key[:-d]) & small[d:]) if len(key) > d else []
            if not len(i):
                break
            i = i[near(ring[i] ^ ring[i + d]) & (ring[i] != ring[i + d])]
            pairs.append((ring[i], ring[i + d], start[i].astype(np.uint64)))
        for at, n in zip(cut[sizes > 8], sizes[sizes > 8]):
            for a, b in forest(ring[at : at + n]):
                pairs.append((a, b, np.full(len(a), start[at], np.uint64)))
        return pairs

    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "start", "ring")]
        new[2] = new[2].view(np.uint64)
        rows = [np.concatenate(x) for x in zip(held, new)]
        if not len(rows[0]):
            continue
        last = int(np.searchsorted(rows[0], rows[0][-1], "left"))  # the last key may go on in the next batch
        held = [x[last:] for x in rows]
        if pairs := scan(*(x[:last] for x in rows)):
            yield out(pairs)
    if pairs := scan(*held):
        yield out(pairs)


def links(prints: DataFrame, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """Links (a, b), a < b, between the distinct fingerprints `fp`: a subset that connects whatever 3 or fewer bits connect."""
    chains = _chains(prints)
    full = staged(chains.groupBy("key").count().filter(F.col("count") > split_above).select("key"), "full")
    start = F.shiftright("key", KEY_BITS)

    def found(rows: DataFrame) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long")

    if full.isEmpty():
        return found(chains.select("key", start.alias("start"), "ring")).distinct()
    rest = chains.join(full, "key", "left_anti").select("key", start.alias("start"), "ring")
    more = chains.join(full, "key", "left_semi")
    after = F.shiftrightunsigned(F.shiftleft("ring", KEY_BITS), BITS - KEY_BITS)
    places = F.array(after, *(after.bitwiseXOR(F.lit(1 << i)) for i in range(KEY_BITS)))
    finer = more.select("key", "ring", F.explode(places).alias("after")).select(F.xxhash64("key", "after").alias("key"), start.alias("start"), "ring")
    return found(rest).union(found(finer)).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b), root the smallest node reachable; alternating large and small stars.

    Each round is a few joins over links, staged in the shared folder; no neighbourhood is gathered into one row.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")

    def star(rows: DataFrame, large: bool) -> DataFrame:
        both = rows.select("u", "v")
        if large:
            both = both.union(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        joined = both.join(low, "u")
        if large:
            out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v")))
        return out.filter("u <> v").distinct()

    mark = None
    for _ in range(most_rounds):
        before, now = now, staged(star(star(now, True), False), "edges")
        discard(before)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen.n, seen.h) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = (seen.n, seen.h)
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", split_above: int = SPLIT_ABOVE) -> DataFrame:
    """(id, fp, component_id) per row: component_id is the smallest id among all documents reachable by links.

    Rows with the same fingerprint are linked. Null or blank texts have fingerprint 0 and are linked like any other.
    Repeated ids stay repeated; a null id takes its component's smallest id. An empty table gives an empty result.
    """
    prints = staged(fingerprints(docs, text, id), "prints")
    each = prints.groupBy("fp").agg(F.min(id).alias("low"))
    root = components(links(each.select("fp"), split_above))
    linked = each.join(root, each.fp == root.node).select("fp", "low", "root")
    # Staged, a large component's least id meets its fingerprints in a plain join, which adaptive execution can split.
    least = staged(linked.groupBy("root").agg(F.min("low").alias("component_id")), "least")
    alone = each.join(root, each.fp == root.node, "left_anti").select("fp", F.col("low").alias("component_id"))
    of = linked.join(least, "root").select("fp", "component_id").union(alone)
    return prints.join(of, "fp").select(id, "fp", "component_id")


#: Near duplicates by similarity: words of a shingle, least Jaccard similarity of the sets of shingles.
WORDS, SIMILARITY = 5, 0.8
#: Least hashes that make up one band, and the chance that a pair just similar enough shares no band.
BAND_ROWS, MISS = 5, 5e-4
#: A bucket's texts are compared in tiles; most texts, and shingles on the average, of a tile's side.
TILE, TILE_SHINGLES = 1024, 1 << 20


def _bands(similarity: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - min(similarity, 0.999) ** BAND_ROWS))


def _sketches(docs: DataFrame, id: str, text: str, words: int, similarity: float) -> DataFrame:
    """(row, id, fp, digest, n, bands, shingles): a text's SimHash fingerprint, its distinct shingles' number, digest and
    32-bit hashes, and its bands of least hashes."""
    n_bands = _bands(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        rng = np.random.default_rng(11)
        masks = rng.integers(0, 1 << 63, n_bands * BAND_ROWS, np.uint64)
        odd = rng.integers(0, 1 << 63, n_bands * BAND_ROWS, np.uint64) | np.uint64(1)
        for batch in batches:
            for part in slices(batch, text):
                out = []
                for t in raw(part, text):
                    hashes = shingle_hashes(t, words)
                    own = np.unique(hashes)
                    least = np.full(n_bands * BAND_ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
                    for at in range(0, len(own), 1 << 12):
                        part_ = own[at : at + (1 << 12)]
                        for k in range(len(masks)):
                            least[k] = min(least[k], ((part_ ^ masks[k]) * odd[k]).min())
                    keys = np.arange(n_bands, dtype=np.uint64)
                    for column in least.reshape(n_bands, BAND_ROWS).T:
                        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
                        keys ^= keys >> np.uint64(29)
                    small = np.unique(own.astype("<u4")).tobytes()
                    out.append((np.uint64(simhash(hashes)).view(np.int64), np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64), len(own), keys.view(np.int64) if len(own) else keys[:0].view(np.int64), small))
                fp, digest, n, bands, small = zip(*out)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), pa.array(fp, pa.int64()), pa.array(digest, pa.int64()), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(small, pa.binary())], ["row", "id", "fp", "digest", "n", "bands", "shingles"])

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.col(text).alias(text) if text not in ("row", "id") else F.col(text).alias("_text"))
    text = rows.columns[-1]
    return rows.mapInArrow(run, f"row long, id {kind}, fp long, digest long, n long, bands array<long>, shingles binary")


def _similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles are similar enough, by an exact count. Both joins are inner, so that a set
    with very many partners is split by adaptive execution."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), "<u4") for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    with_x = pairs.join(sets.select(F.col("digest").alias("a"), F.col("shingles").alias("x")), "a")
    return with_x.join(sets.select(F.col("digest").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _tile_links(similarity: float):
    """Sorted (tile, side, root, shingles) rows to links between roots: a spanning forest of a tile's links.

    Each text of side true is compared with each of the other side, by exact counts; those of one root are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
            """The number of common shingles of each of x with each of y: products of 0-1 matrices, some columns at a time."""
            n = np.zeros((len(x), len(y)), np.int64)
            tokens = [np.concatenate(z) for z in (x, y)]
            common = np.intersect1d(*tokens)
            sides = []
            for z, t in zip((x, y), tokens):
                at = np.searchsorted(common, t)
                hit = np.flatnonzero(common[np.minimum(at, len(common) - 1)] == t) if len(common) else np.zeros(0, np.int64)
                hit = hit[np.argsort(at[hit], kind="stable")]
                sides.append((np.repeat(np.arange(len(z)), [len(v) for v in z])[hit], at[hit]))
            for low in range(0, len(common), 1 << 12):
                width = min(1 << 12, len(common) - low)
                parts = []
                for z, (row, at) in zip((x, y), sides):
                    a, b = np.searchsorted(at, (low, low + width))
                    m = np.zeros((len(z), width), np.float32)
                    m[row[a:b], at[a:b] - low] = 1
                    parts.append(m)
                n += (parts[0] @ parts[1].T).astype(np.int64)
            return n

        def forest(rows: pa.Table) -> list[tuple[int, int]]:
            side, root = (rows.column(c).to_numpy() for c in ("side", "root"))
            if side.all() or not side.any():
                return []
            sets = [np.frombuffer(v.as_buffer(), "<u4") for v in rows.column("shingles")]
            at = [np.flatnonzero(side), np.flatnonzero(~side)]
            x, y = ([sets[i] for i in z] for z in at)
            both = shared(x, y)
            sizes = [np.array([len(v) for v in z]) for z in (x, y)]
            ok = (both >= similarity * (sizes[0][:, None] + sizes[1] - both)) & (root[at[0]][:, None] != root[at[1]])
            i, j = np.nonzero(ok)
            up: dict[int, int] = {}

            def find(v: int) -> int:
                while (w := up.get(v, v)) != v:
                    up[v] = v = up.get(w, w)
                return v

            out, left = [], len(np.unique(root)) - 1
            for a, b in np.unique(np.stack([root[at[0]][i], root[at[1]][j]]), axis=1).T.tolist():
                if (p := find(a)) != (q := find(b)):
                    up[p] = q
                    out.append((a, b))
                    if len(out) == left:
                        break
            return out

        def links(rows: pa.Table, cut: np.ndarray) -> pa.RecordBatch:
            found = [pair for a, b in zip(cut[:-1], cut[1:]) for pair in forest(rows.slice(a, b - a))]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (pa.concat_tables([held, rows]) if held is not None else rows).combine_chunks()
            if rows.num_rows:
                tile = rows.column("tile").to_numpy()
                cut = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
                yield links(rows, cut)
                held = rows.slice(cut[-1])  # the last tile may go on in the next batch
        if held is not None:
            yield links(held, np.array([0, held.num_rows]))

    return run


def _rest(members: DataFrame, root: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between the components `root`, from all pairs of texts that share a bucket and aren't connected yet.

    In each bucket, the texts outside its main component meet all its texts. Both are dealt to slots of bounded size, and
    a pair of slots is a tile, which one task compares: a text is sent once for each slot of the other side.
    """
    now = members.join(root, members.digest == root.node, "left").select("key", "digest", "n", F.coalesce("root", "digest").alias("root"))
    sizes = now.groupBy("key", "root").agg(F.count("*").alias("size"), F.sum("n").alias("words"), *(F.bit_xor(F.xxhash64("digest", F.lit(k))).alias(f"mark{k}") for k in (0, 1)))
    top = F.max(F.struct("size", "root", "words"))
    buckets = sizes.groupBy("key").agg(F.count("*").alias("parts"), top.alias("top"), F.sum("size").alias("size"), F.sum("words").alias("words"), F.bit_xor("mark0").alias("mark0"), F.bit_xor("mark1").alias("mark1")).filter("parts > 1")
    # Buckets of the same texts are compared once.
    buckets = buckets.groupBy("size", "mark0", "mark1").agg(F.min(F.struct("key", "top", "words")).alias("b")).select("size", "b.*")

    def slots(size: Column, words: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(size / TILE), F.ceil(words / TILE_SHINGLES)).cast("int")

    buckets = buckets.select("key", F.col("top.root").alias("main"), slots(F.col("size") - F.col("top.size"), F.col("words") - F.col("top.words")).alias("outer"), slots(F.col("size"), F.col("words")).alias("inner"))
    dealt = staged(now.join(buckets, "key"), "mixed")

    def side(rows: DataFrame, own: str, other: str, first: bool) -> DataFrame:
        slot, each = F.pmod(F.xxhash64("digest", F.lit(own)), F.col(own)), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("each")
        rows = rows.select("key", "digest", "root", slot.cast("int").alias("slot"), each)
        return rows.select(F.xxhash64("key", "slot", "each") if first else F.xxhash64("key", "each", "slot"), F.lit(first), "root", "digest").toDF("tile", "side", "root", "digest")

    rows = side(dealt.filter("root <> main"), "outer", "inner", True).union(side(dealt, "inner", "outer", False))
    rows = rows.join(sets, "digest").select("tile", "side", "root", "shingles")
    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tile_links(similarity), "a long, b long").distinct()


def similar(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(id, component_id) per row: component_id is the smallest id among the documents reachable by links. Texts are linked
    if their sets of `words`-word shingles have a Jaccard similarity of `similarity` or more, counted exactly.

    Candidates are fingerprints within 3 bits, by pigeonring, and, since texts just similar enough lie up to a dozen bits
    apart, texts that share one of the bands of least hashes (a pair of similarity 0.8 shares none with a chance of 5 in
    10,000, a closer one with less). Every candidate is decided by an exact count or is connected already: each text is
    compared with the least of its buckets' representatives; then, in each bucket that still holds several components, all
    texts outside its main one with all texts of the bucket, in tiles of bounded size that yield a spanning forest. No
    bucket is capped. Texts with equal sets are one class throughout.

    Null or wordless texts are alike. Repeated ids stay repeated; a null id takes its component's smallest id. An empty
    table gives an empty result.
    """
    with scratch(docs.sparkSession) as keep:
        made = staged(_sketches(docs, id, text, words, similarity), "sketches")
        each = staged(made.groupBy("digest").agg(F.min("id").alias("low"), F.min("row").alias("row"), F.min("n").alias("n")), "classes")
        by_print = staged(made.select("fp", "digest").distinct(), "prints")
        heads = staged(by_print.groupBy("fp").agg(F.min("digest").alias("head")), "heads")
        near = links(heads.select("fp"))
        ends = [heads.select(F.col("fp").alias(e), F.col("head").alias(f"head_{e}")) for e in "ab"]
        pairs = near.join(ends[0], "a").join(ends[1], "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
        pairs = pairs.union(by_print.join(heads, "fp").select(F.col("digest").alias("a"), F.col("head").alias("b")))
        members = made.select("digest", "n", F.explode("bands").alias("key")).distinct()
        full = staged(members.groupBy("key").count().filter("count > 1").select("key"), "buckets")
        left = staged(members.join(full, "key"), "members")
        alike = F.least("n", "head_n") >= similarity * F.greatest("n", "head_n")
        pairs = staged(pairs.distinct(), "candidates")
        of = staged(left.select("digest").union(pairs.select("a")).union(pairs.select("b")).distinct(), "wanted")
        sets = staged(made.select("row", "shingles").join(each.join(of, "digest").select("row", "digest"), "row").select("digest", "shingles"), "sets")
        # Each text meets the least of its buckets' representatives first, a pair a text; then the rest of its buckets.
        heads = left.groupBy("key").agg(F.min(F.struct("digest", "n")).alias("h")).select("key", F.col("h.digest").alias("head"), F.col("h.n").alias("head_n"))
        first = left.join(heads, "key").groupBy("digest", "n").agg(F.min(F.struct("head", "head_n")).alias("h")).select("digest", "n", "h.head", "h.head_n")
        close = first.filter(alike).select(F.col("digest").alias("a"), F.col("head").alias("b")).union(pairs)
        close = staged(close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "pairs")
        root = staged(components(staged(_similar_pairs(close, sets, similarity), "similar")), "roots")
        more = staged(_rest(left, root, sets, similarity), "more")
        root = components(more.union(root.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        linked = each.join(root, each.digest == root.node).select("digest", "low", "root")
        least = staged(linked.groupBy("root").agg(F.min("low").alias("component_id")), "least")
        alone = each.join(root, each.digest == root.node, "left_anti").select("digest", F.col("low").alias("component_id"))
        of = linked.join(least, "root").select("digest", "component_id").union(alone)
        return keep(staged(made.select("id", "digest").join(of, "digest").select(F.col("id").alias(id), "component_id"), "groups"))


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near duplicates (see `similar`): the one with the smallest id; of repeated rows of that id,
    one.

    The texts are shuffled once, to meet the decisions by id; the hint keeps that so at every size.
    """
    marks = similar(docs, id, text, words, similarity)
    kept = staged(marks.filter(F.col(id).eqNullSafe(F.col("component_id"))).groupBy(F.col(id).alias("_kept")).agg(F.count("*").alias("_n")), "kept")
    left = docs.join(kept.select("_kept").hint("merge"), docs[id].eqNullSafe(F.col("_kept")), "left_semi")
    twice = kept.filter("_n > 1").select("_kept")
    if twice.isEmpty():
        return left
    mark = free_name(docs, "_text_hash")
    same = left.withColumn(mark, F.sha2(F.coalesce(text, F.lit("")), 256)).join(twice, left[id].eqNullSafe(F.col("_kept")), "left_semi").dropDuplicates([id, mark]).drop(mark)
    return left.join(twice, left[id].eqNullSafe(F.col("_kept")), "left_anti").union(same)
