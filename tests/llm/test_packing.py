import random
import zlib

import numpy as np
from evidex.llm import packing as P
from tokenizers import Tokenizer


def slow_bins(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for capacity in (1, 7, 64, 100):
        for _ in range(20):
            lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(300))]
            plan = P.best_fit_plan({n: lengths.count(n) for n in set(lengths)}, capacity)
            used = {}
            for length, _, n, at, offset in plan:
                for b in range(at, at + n):
                    assert used.get(b, 0) == offset
                    used[b] = offset + length
            assert sorted(capacity - u for u in used.values()) == slow_bins(lengths, capacity)


def test_pack_whole(spark, sf):
    texts = ["", None, "a", "hello <|endoftext|> there", "日本語 text", "word " * 5000, "a", "x y z"]
    odd = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(odd)
    rows = P.pack(docs.selectExpr("*", "1 AS part", "2 AS length")).collect()
    slow = Tokenizer.from_file(P.default_files()[0])
    want = []
    for r in docs.collect():
        ids = [*slow.encode(r.text or "", add_special_tokens=False).ids, 2]
        at, n, k = 0, len(ids) % 1024 or 1024, 0
        while at < len(ids):
            want.append((r.doc_id, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at, n, k = at + n, 1024, k + 1
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(bins) == len(slow_bins([w[3] for w in want], 1024))


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
