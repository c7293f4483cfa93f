"""Benchmark decontamination with suffix arrays over shards of the training texts.

Each task cuts its rows into shards of a few megabytes and concatenates their words, as numbers of the benchmark's
vocabulary; a word that no benchmark item has is a separator, since no match can hold it. The shard's suffix array
(sorted, as far as a window reaches, over the suffixes that can begin a window) is binary-searched for every suffix of
every test item; neighbouring hits of one item on one diagonal join to the longest verbatim matches, with locations in
both texts. Those decide: a word inside a match is hit, and a document with a match is contaminated.

The only thing sent to all tasks is the benchmark, in blocks of a bounded number of words: a larger benchmark takes
several passes, whose matches travel along with the rows. There is no shuffle and nothing grows with a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard
from .common import free_name, raw, schema_of, slices, staged

WINDOW = 10
#: Words of the benchmark in one pass at most (an item is never divided).
BLOCK_WORDS = 2_000_000
_BLANK = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased words: runs of ASCII letters, digits and everything beyond ASCII."""
    return text.lower().translate(_BLANK).split()


class TestIndex:
    """The windows of one block of test items: `by` holds for each window length its sorted keys and where they are."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        import numpy as np

        self.ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        found: dict[int, list] = {}
        for k, (_, words) in enumerate(items):
            row = np.array([number(w, len(self.vocabulary) + 1) for w in words], ">u4")
            n = min(window, len(words))
            if n:
                keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(row, n)).view(f"S{4 * n}").ravel()
                found.setdefault(n, []).append((keys, np.full(len(keys), k), np.arange(len(keys)), row[: len(row) - n + 1]))
        self.by = {}
        for n, parts in found.items():
            keys, item, at, first = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(keys, kind="stable")
            starts = np.zeros(len(self.vocabulary) + 1, bool)
            starts[first.astype(np.int64)] = True
            unique, begin = np.unique(keys[order], return_index=True)
            self.by[n] = (unique, np.r_[begin, len(keys)], item[order], at[order], starts)


def _hits(index: TestIndex, ids):
    """(window length, position in the shard, item, place in the item) of every occurrence of every window."""
    import numpy as np

    foreign = np.r_[np.flatnonzero(ids == 0), len(ids)]
    run = foreign[np.searchsorted(foreign, np.arange(len(ids)))] - np.arange(len(ids))
    big = ids.astype(">u4")
    for n, (keys, begin, item, at, starts) in index.by.items():
        at_start = np.flatnonzero((run >= n) & starts[np.minimum(ids, len(starts) - 1)] & (ids < len(starts)))
        if not len(at_start):
            continue
        suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(big, n)[at_start]).view(f"S{4 * n}").ravel()
        order = np.argsort(suffixes, kind="stable")
        suffixes, places = suffixes[order], at_start[order]
        low, high = np.searchsorted(suffixes, keys, "left"), np.searchsorted(suffixes, keys, "right")
        for k in np.flatnonzero(high > low):
            p = places[low[k] : high[k]]
            for j in range(begin[k], begin[k + 1]):
                yield n, p, item[j], at[j]


def _shard(index: TestIndex, texts: list[bytes]):
    """Words of each text, and the shard's tokens, one separator after each text."""
    import numpy as np

    get = index.vocabulary.get
    rows = [words_of(t) for t in texts]
    sizes = np.array([len(r) for r in rows], np.int64)
    flat: list[int] = []
    for r in rows:
        flat.extend([get(w, 0) for w in r])
        flat.append(0)
    return sizes, np.r_[0, np.cumsum(sizes + 1)], np.array(flat, np.int64)


def _blocks(bench: DataFrame, id: str, text: str, block_words: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The benchmark in blocks of a bounded number of words, one at a time on the driver."""
    block, n = [], 0
    for row in bench.select(F.col(id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        words = words_of((row.t or "").encode())
        if block and n + len(words) > block_words:
            yield block
            block, n = [], 0
        if words:
            block.append((row.i, words))
            n += len(words)
    if block:
        yield block


def _matches(index: TestIndex, ids, begin):
    """The longest verbatim matches of at least a window in a shard: arrays of text, item, place in the text, place in the
    item and number of words. Hits of one item on one diagonal whose windows follow each other are one match."""
    import numpy as np

    parts = [(np.full(len(p), i), p - a, p, np.full(len(p), n)) for n, p, i, a in _hits(index, ids)]
    if not parts:
        return [np.zeros(0, np.int64)] * 5
    item, diagonal, p, n = (np.concatenate(x).astype(np.int64) for x in zip(*parts))
    order = np.lexsort((p, diagonal, item))
    item, diagonal, p, n = item[order], diagonal[order], p[order], n[order]
    new = np.flatnonzero(np.r_[True, (np.diff(item) != 0) | (np.diff(diagonal) != 0) | (np.diff(p) != 1)])
    last = np.r_[new[1:], len(item)] - 1
    doc = np.searchsorted(begin, p[new], "right") - 1
    return [doc, item[new], p[new] - begin[doc], (p - diagonal)[new], p[last] - p[new] + n[new]]


MATCH = "array<struct<item:string,start:bigint,item_start:bigint,n_words:bigint>>"


def _marked(docs: DataFrame, bench: DataFrame, keep: list[str], text: str, item: str, item_text: str, window: int, block_words: int) -> tuple[DataFrame, list[str]]:
    """`keep` and four more columns, also returned by name: the number of words, the bitmap of hit words, the items, and
    the longest matches. Each block of the benchmark is one pass; the driver and a task hold one block at a time, so
    between blocks the rows are staged."""
    spark = docs.sparkSession
    more = [free_name(docs, c) for c in ("_n", "_cover", "_items", "_matches")]
    empty = (F.lit(0).cast("long"), F.lit(None).cast("binary"), F.array().cast("array<string>"), F.array().cast(MATCH))
    rows = docs.select(*keep, *({text} - {*keep}), *(x.alias(c) for c, x in zip(more, empty)))
    schema, names = schema_of(rows, *rows.columns), rows.columns
    struct = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int64()), ("item_start", pa.int64()), ("n_words", pa.int64())]))
    before = None
    for k, block in enumerate(chain(_blocks(bench, item, item_text, block_words), [None])):
        if block is None and k:  # a benchmark without words still takes one pass, which counts words
            break
        if k:
            rows = staged(rows, "matched")
            if before:
                discard(before)
            before = rows
        send = spark.sparkContext.broadcast(TestIndex(block or [], window))

        def run(batches, send=send):
            import numpy as np

            index = send.value
            for batch in batches:
                for part in slices(batch, text):
                    sizes, begin, ids = _shard(index, raw(part, text))
                    found = _matches(index, ids, begin)
                    covers, items, matches = (part.column(c).to_pylist() for c in more[1:])
                    order = np.argsort(found[0], kind="stable")
                    docs_ = found[0][order]
                    for at in np.flatnonzero(np.r_[True, docs_[1:] != docs_[:-1]]) if len(docs_) else ():
                        doc = int(docs_[at])
                        mine = order[at : np.searchsorted(docs_, doc, "right")]
                        step = np.zeros(sizes[doc] + 1, np.int64)
                        np.add.at(step, found[2][mine], 1)
                        np.add.at(step, found[2][mine] + found[4][mine], -1)
                        bits = np.packbits(np.cumsum(step)[:-1] > 0)
                        covers[doc] = (bits if covers[doc] is None else bits | np.frombuffer(covers[doc], np.uint8)).tobytes()
                        here = [{"item": str(index.ids[i]), "start": s, "item_start": a, "n_words": n} for i, s, a, n in zip(*(found[c][mine].tolist() for c in (1, 2, 3, 4)))]
                        items[doc] = sorted({*items[doc], *(m["item"] for m in here)})
                        matches[doc] = sorted(matches[doc] + here, key=lambda m: (m["start"], m["item"], m["item_start"]))
                    new = dict(zip(more, (pa.array(sizes), pa.array(covers, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(matches, struct))))
                    yield pa.RecordBatch.from_arrays([new[c] if c in new else part.column(c) for c in names], names)

        rows = rows.mapInArrow(run, schema)
    return rows, more


def longest_matches(docs: DataFrame, bench: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, item, start, item_start, n_words) of every longest verbatim match of at least a window, in words of both texts.

    Null and wordless texts have none; repeated rows have theirs each; columns beside id and text don't matter; an empty
    table or benchmark gives an empty result.
    """
    rows, (_, _, _, matches) = _marked(docs, bench, [id], text, item, item_text, window, block_words)
    kind = bench.schema[item].dataType
    return rows.select(id, F.explode(matches).alias("m")).select(id, F.col("m.item").cast(kind).alias("item"), "m.start", "m.item_start", "m.n_words")


def contamination(docs: DataFrame, bench: DataFrame, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`keep` columns and n_words, n_hit, items (as strings, sorted) and matches (longest matches and locations) per row.

    Null and wordless texts have no words and no hits; a text shorter than an item's window can't hold it; repeated rows
    are judged one by one. Without a benchmark nothing is hit. Items without words are never found.
    """
    rows, (n, cover, items, matches) = _marked(docs, bench, keep, text, item, item_text, window, block_words)
    return rows.select(*keep, F.col(n).alias("n_words"), _popcount(cover).alias("n_hit"), F.col(items).alias("items"), F.col(matches).alias("matches"))


def _popcount(bitmap: str):
    """Bits set in a bitmap."""
    digits = F.hex(bitmap)
    bits = "0112122312232334"
    return F.coalesce(sum(((F.length(digits) - F.length(F.regexp_replace(digits, f"[{''.join('0123456789ABCDEF'[i] for i in range(16) if bits[i] == str(b))}]", ""))) * b for b in range(1, 5)), F.lit(0)), F.lit(0)).cast("long")


def clean(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows that share no window with the benchmark, all columns kept."""
    rows, (_, cover, _, _) = _marked(docs, bench, docs.columns, text, item, item_text, window, block_words)
    return rows.filter(F.col(cover).isNull()).select(*docs.columns)


def items_digest(items: str = "items"):
    """Lower-case SHA-256 of the sorted ids, comma-joined."""
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)
