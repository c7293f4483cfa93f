"""Best-fit-decreasing packing of documents into token sequences.

Pieces of equal length are alike to best fit, so the placing is worked out on the histogram of lengths: at most
`capacity` rows, whatever the corpus. From the longest length down, a segment tree over the remaining capacities finds
the tightest open capacity in logarithmic time, and a run of bins of that capacity takes a run of pieces at once. That
gives just the bins of piece-by-piece best fit decreasing. The plan, runs of pieces onto runs of bins, has a number of
rows that depends on the capacity alone. Spark numbers the pieces of each length (within a partition, then by a running
sum over partitions) and each piece looks up its run.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, staged

CAPACITY, END = 1024, 2
SPECIAL = "<|endoftext|>"


class Encoder:
    """Token ids of texts, as the tokenizer file gives them without added special tokens.

    The same vocabulary is also given as byte ranks, several times faster to apply; it serves texts in the Latin
    scripts, on which both splitters agree. Everything else, and texts that hold the special token's string, take the
    tokenizer file itself.
    """

    def __init__(self, tokenizer: str, ranks: str | None = None):
        import base64
        import re

        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer)
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.other = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ‐-‧‰-⁞€]")

    def __call__(self, text: str) -> list[int]:
        if self.fast and SPECIAL not in text and not self.other.search(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


_encoders: dict[tuple, Encoder] = {}


def encoder(tokenizer: str, ranks: str | None) -> Encoder:
    """One encoder a Python worker."""
    return _encoders.setdefault((tokenizer, ranks), None) or _encoders.__setitem__((tokenizer, ranks), Encoder(tokenizer, ranks)) or _encoders[tokenizer, ranks]


def default_files() -> tuple[str, str]:
    """The public byte-level vocabulary: as a tokenizer file and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, nth): each document's ids and the end id, in pieces of at most `capacity`.

    A longer document's first piece takes what the full ones leave. `nth` numbers a partition's pieces of one length.
    Null texts are empty: one piece with the end id alone.
    """
    if tokenizer is None:
        tokenizer, ranks = default_files()
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        encode, part, seen = encoder(tokenizer, ranks), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows in slices(batch, text):
                out: list[tuple] = []
                for k, t in enumerate(rows.column(text).to_pylist()):
                    ids = np.array([*encode(t or ""), end], "<u4")
                    first = len(ids) % capacity or capacity
                    for n, (a, b) in enumerate(itertools.pairwise([0, *range(first, len(ids) + 1, capacity)])):
                        out.append((k, n, a, b - a, zlib.crc32(ids[a:b].tobytes()), part, int(seen[b - a])))
                        seen[b - a] += 1
                columns = [pa.array(x) for x in zip(*out)]
                columns[1], columns[5] = columns[1].cast(pa.int32()), columns[5].cast(pa.int32())
                yield pa.RecordBatch.from_arrays([rows.column(id).take(columns[0]), *columns[1:]], ["doc", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(id, *({text} - {id})).mapInArrow(run, f"doc {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


class Capacities:
    """A segment tree over capacities 0 to n: whether a bin with just that room is open."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, room: int, is_open: bool) -> None:
        at = room + self.size
        self.open[at] = is_open
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity of at least `least`."""
        at = least + self.size
        while not self.open[at]:
            while at & 1:  # a right child: nothing further right below this parent
                at //= 2
                if at == 0:
                    return None
            if at == 0:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first, n, bin, offset) rows: pieces first..first+n-1 of a length go to bins bin..bin+n-1 at an offset."""
    rooms: dict[int, list[tuple[int, int]]] = {}
    tree, plan, bins = Capacities(capacity), [], 0
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        first, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            fresh = room is None
            room = capacity if fresh else room
            per = min(room // length, left)  # the bin just used stays the tightest while it has room for another piece
            want = left // per
            at, n = (bins, want) if fresh else rooms[room].pop()
            if fresh:
                bins += n
            else:
                if n > want:
                    rooms[room].append((at + want, n - want))
                    n = want
                tree.set(room, bool(rooms[room]))
            for layer in range(per):
                plan.append((length, first, n, at, capacity - room + layer * length))
                first += n
            left -= n * per
            if rest := room - per * length:
                rooms.setdefault(rest, []).append((at, n))
                tree.set(rest, True)
    return plan


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, **options) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset; see `pieces`. An empty table packs to nothing."""
    cut = staged(pieces(docs, id, text, capacity, **options), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    send = docs.sparkSession.sparkContext.broadcast(best_fit_plan(histogram, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        plan = np.array(sorted(send.value), np.int64).reshape(-1, 5)
        keys = (plan[:, 0] << 48) + plan[:, 1]
        for batch in batches:
            length, nth = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "nth"))
            row = plan[np.searchsorted(keys, (length << 48) + nth, "right") - 1] if len(nth) else plan[:0]
            new = [pa.array(row[:, 3] + nth - row[:, 1]), pa.array(row[:, 4])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "piece", "start", "length", "ids_crc32")), *new], names)

    names = [id, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kind = cut.schema["doc"].dataType.simpleString()
    placed = cut.join(before, ["length", "part"]).select("doc", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("nth"))
    return placed.mapInArrow(place, f"`{id}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, `offset` long")
