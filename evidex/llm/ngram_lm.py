"""Language-model scores from Elias-Fano n-gram tries.

The trie has a unigram and a bigram level, both in Elias-Fano code. The unigram level holds its sorted words, beside them
their counts and quantised smoothed probabilities. The bigram level holds its sorted contexts, its vocabulary, the
monotone pointers to where each context's successors begin, and the successors relative to their context (ranks of
context and word together are monotone); beside them quantised smoothed probabilities and each context's quantised
back-off weight. A query finds the context, then searches its successors for the next one not below the word. Levels lie
in one buffer and are queried memory-mapped.

p(w | u) = c(u w) / (c(u) + mu) + mu / (c(u) + mu) * p(w),  p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).

A model of all n-grams grows with the corpus, so no task holds it whole. Documents are read into blocks: a block is
their tokens as numbers of its own sorted words. Blocks send each shard their distinct n-grams with training counts; the
shard merges the counts, builds its level and answers the same n-grams; the blocks then score their documents. What moves
is a few bytes per distinct n-gram of a block, in packed rows per block and shard. Shards hold n-grams by hash of the
context; contexts with a large share of all tokens are divided further by word, and for those, a list of at most
1 / LEAST_HOT entries, the context's count is summed beforehand. Words are told apart by 64 bits in the unigram level and
by 48 bits in the bigram level. Exact counts serve the base score and n_known; the model's own score reads the quantised
probabilities.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import raw, slices, staged

MU, BLOCK_TOKENS, SHARD_BYTES = 500.0, 1_000_000, 24 << 20
#: Quantisation: 255 steps of log10 from 0 down; 0 stands for none.
STEP = 8.0 / 254
#: The unigram level's finer steps, in 16 bits: unigrams back off to nothing, and rare ones of a large corpus lie far down.
FINE = 20.0 / 65_534
#: A context with less than this share of all tokens is never divided, so the list of divided ones stays short.
LEAST_HOT = 1e-5
W48 = (1 << 48) - 1


class EliasFano:
    """A sorted sequence of unsigned numbers: high parts in unary, low parts packed; arrays in, arrays out."""

    def __init__(self, values, parts=None):
        import numpy as np

        if parts is not None:
            self.n, self.low_bits, self.high, self.ones, self.low = parts
            return
        values = np.asarray(values, np.uint64)
        n = self.n = len(values)
        top = int(values[-1]) + 1 if n else 1
        self.low_bits = k = max(0, (top // max(n, 1)).bit_length() - 1)
        at = (values >> np.uint64(k)).astype(np.int64) + np.arange(n)
        bits = np.zeros((((int(at[-1]) + 2 if n else 1) + 63) // 64) * 64, np.uint8)
        bits[at] = 1
        self.high = np.packbits(bits, bitorder="little").view("<u8")
        self.ones = np.r_[0, np.cumsum(np.bitwise_count(self.high), dtype=np.int64)]
        if k:
            each = np.unpackbits((values & np.uint64((1 << k) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little", count=k)
            self.low = np.r_[np.packbits(each.ravel(), bitorder="little"), np.zeros(16, np.uint8)]
        else:
            self.low = np.zeros(16, np.uint8)

    def _select(self, k, one: bool):
        """The positions of the k-th ones or zeros, from 0."""
        import numpy as np

        before = self.ones if one else np.arange(len(self.ones)) * 64 - self.ones
        word = np.searchsorted(before, k, "right") - 1
        word = np.minimum(word, len(self.high) - 1)
        left, bits, at = k - before[word], self.high[word] if one else ~self.high[word], np.zeros(len(k), np.uint64)
        for width in (32, 16, 8, 4, 2, 1):
            n = np.bitwise_count((bits >> at) & np.uint64((1 << width) - 1)).astype(np.int64)
            go = n <= left
            left = left - np.where(go, n, 0)
            at = at + np.where(go, width, 0).astype(np.uint64)
        return word * 64 + at.astype(np.int64)

    def _lows(self, i):
        import numpy as np

        k = self.low_bits
        if not k:
            return np.zeros(len(i), np.uint64)
        bit = i * k
        windows = np.lib.stride_tricks.sliding_window_view(self.low, 8)[bit >> 3]
        word = np.ascontiguousarray(windows).view("<u8").ravel() >> (bit & 7).astype(np.uint64)
        if k > 57:  # the window's last bits lie in a ninth byte
            more = self.low[(bit >> 3) + 8].astype(np.uint64)
            shift = (np.uint64(64) - (bit & 7).astype(np.uint64)) % np.uint64(64)
            word = np.where((bit & 7) > 0, word | (more << shift), word)
        return word & np.uint64((1 << k) - 1)

    def get(self, i):
        import numpy as np

        i = np.asarray(i, np.int64)
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(i)

    def find(self, values):
        """The index of each value, or -1: a successor search in the run of equal high parts."""
        import numpy as np

        values = np.asarray(values, np.uint64)
        if not self.n:
            return np.full(len(values), -1, np.int64)
        h = (values >> np.uint64(self.low_bits)).astype(np.int64)
        zeros = len(self.high) * 64 - int(self.ones[-1])
        inside = h < zeros
        h = np.where(inside, h, 0)
        lo = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) - (h - 1), 0)
        end = np.where(inside, self._select(h, False) - h, lo)
        end = np.minimum(end, self.n)
        lo = np.minimum(lo, end)
        low, hi = values & np.uint64((1 << self.low_bits) - 1), end.copy()
        while (busy := lo < hi).any():
            mid = (lo + hi) >> 1
            less = np.zeros(len(values), bool)
            less[busy] = self._lows(mid[busy]) < low[busy]
            lo, hi = np.where(busy & less, mid + 1, lo), np.where(busy & ~less, mid, hi)
        hit = lo < end
        hit[hit] = self._lows(lo[hit]) == low[hit]
        return np.where(hit, lo, -1)


def quantised(x):
    """log10 values of at most 0 as bytes 1 to 255."""
    import numpy as np

    return (1 + np.clip(np.rint(-x / STEP), 0, 254)).astype(np.uint8)


def restored(q):
    """Probabilities of bytes; 0 for none."""
    import numpy as np

    table = np.r_[0.0, 10.0 ** (-STEP * np.arange(255))]
    return table[q]


def _mapped(codes: dict[str, EliasFano], arrays: dict) -> tuple[dict[str, EliasFano], dict]:
    """Elias-Fano codes and arrays as views of one unnamed file that is memory-mapped. The file belongs to one task and is
    read by it alone."""
    import numpy as np

    at, places = 0, {}
    with tempfile.TemporaryFile() as f:
        def put(a):
            nonlocal at
            f.write(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % 8))
            at += a.nbytes + -a.nbytes % 8
            return at - a.nbytes - -a.nbytes % 8, a.dtype, len(a)

        for name, e in codes.items():
            places[name] = e.n, e.low_bits, *map(put, (e.high, e.ones, e.low))
        for name, a in arrays.items():
            places[name] = put(a)
        f.flush()
        whole = np.memmap(f, np.uint8, "r", shape=(max(at, 1),)) if at else np.zeros(1, np.uint8)
    view = lambda p: whole[p[0] : p[0] + p[2] * p[1].itemsize].view(p[1])
    made = {name: EliasFano(None, (places[name][0], places[name][1], *map(view, places[name][2:]))) for name in codes}
    return made, {name: view(places[name]) for name in arrays}


class Unigrams:
    """The unigram level over sorted 64-bit words with counts; probabilities are (count + 0.5) / total in 16-bit steps."""

    def __init__(self, words, counts, total: int):
        import numpy as np

        self.words, self.counts = EliasFano(words), np.asarray(counts, "<i8")
        logs = np.log10((self.counts + 0.5) / max(total, 1))
        self.probabilities = (1 + np.clip(np.rint(-logs / FINE), 0, 65_534)).astype("<u2")

    def mapped(self) -> Unigrams:
        out = object.__new__(Unigrams)
        codes, arrays = _mapped({"words": self.words}, {"counts": self.counts, "probabilities": self.probabilities})
        out.__dict__.update(codes | arrays)
        return out

    def ask(self, words):
        """(counts, quantised probabilities) of words; both 0 where the level has no such word."""
        import numpy as np

        at = self.words.find(words)
        if not self.words.n:
            return np.zeros(len(words), "<i8"), np.zeros(len(words), "<u2")
        known = np.maximum(at, 0)
        return np.where(at >= 0, self.counts[known], 0), np.where(at >= 0, self.probabilities[known], 0).astype("<u2")


class Level:
    """A bigram level over sorted (context, word) pairs with counts; `totals`: counts of contexts that other shards share."""

    def __init__(self, contexts, words, counts, mu: float = MU, totals: dict[int, int] | None = None):
        import numpy as np

        begin = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]]) if len(contexts) else np.zeros(0, np.int64)
        own = contexts[begin]
        rank = np.cumsum(np.r_[True, contexts[1:] != contexts[:-1]])[: len(contexts)].astype(np.uint64) - np.uint64(1) if len(contexts) else contexts
        total = np.add.reduceat(counts, begin).astype(float) if len(begin) else np.zeros(0)
        self.shared = np.array(sorted(totals or ()), np.uint64)
        sums = np.array([totals[int(u)] for u in self.shared], float) if totals else np.zeros(0)
        self.shared_weights = quantised(np.log10(mu / (sums + mu)))
        if len(sums):
            k = np.minimum(np.searchsorted(self.shared, own), len(sums) - 1)
            total = np.where(self.shared[k] == own, sums[k], total)
        each = total[rank.astype(np.int64)] if len(contexts) else total
        vocabulary, place = np.unique(words, return_inverse=True)
        self.contexts, self.pointers, self.vocabulary = EliasFano(own), EliasFano(np.r_[begin, len(contexts)]), EliasFano(vocabulary)
        self.successors = EliasFano(rank * np.uint64(len(vocabulary)) + place.astype(np.uint64))
        self.weights, self.probabilities = quantised(np.log10(mu / (total + mu))), quantised(np.log10(np.maximum(counts, 1) / (each + mu)))

    def mapped(self) -> Level:
        """The same level, its arrays in one memory-mapped file."""
        out = object.__new__(Level)
        codes = {n: getattr(self, n) for n in ("contexts", "pointers", "vocabulary", "successors")}
        codes, arrays = _mapped(codes, {"weights": self.weights, "probabilities": self.probabilities})
        out.__dict__.update(codes | arrays | {"shared": self.shared, "shared_weights": self.shared_weights})
        return out

    def ask(self, contexts, words):
        """(probability bytes, back-off bytes) of each pair; 0 where the trie has no such pair, and weight 1 for no context."""
        import numpy as np

        at, word = self.contexts.find(contexts), self.vocabulary.find(np.asarray(words, np.uint64))
        known = at >= 0
        weight = np.ones(len(contexts), np.uint8)
        q = np.zeros(len(contexts), np.uint8)
        weight[known] = self.weights[at[known]]
        both = np.flatnonzero(known & (word >= 0))
        if len(both):
            place = self.successors.find(at[both].astype(np.uint64) * np.uint64(self.vocabulary.n) + word[both].astype(np.uint64))
            q[both] = np.where(place >= 0, self.probabilities[np.maximum(place, 0)], 0)
        if len(self.shared):  # such a context has its weight even where this shard holds none of its successors
            k = np.minimum(np.searchsorted(self.shared, contexts), len(self.shared) - 1)
            weight = np.where(self.shared[k] == contexts, self.shared_weights[k], weight)
        return q, weight


def _pack(*arrays) -> bytes:
    """Number arrays as one compressed run of bytes."""
    import numpy as np
    import zstandard

    head = np.array([len(arrays), *(x for a in arrays for x in (a.nbytes, ord(a.dtype.char)))], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(data: bytes) -> list:
    import numpy as np
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    sizes = np.frombuffer(data, "<u4", 2 * n, 4).reshape(-1, 2)
    at, out = 4 + 8 * n, []
    for size, kind in sizes.tolist():
        dtype = np.dtype(chr(kind))
        out.append(np.frombuffer(data, dtype, size // dtype.itemsize, at))
        at += size
    return out


def _pack48(a) -> object:
    """Numbers below 2^48, six bytes each."""
    import numpy as np

    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).ravel()


def _unpack48(a):
    import numpy as np

    out = np.zeros((len(a) // 6, 8), np.uint8)
    out[:, :6] = a.reshape(-1, 6)
    return out.ravel().view("<u8")


BLOCK = "block long, ids array<{0}>, held array<boolean>, sizes array<int>, stream binary, words binary, n_train long"


def blocks(docs: DataFrame, id: str, text: str, held: Column, block_tokens: int) -> DataFrame:
    """Documents as blocks: per document its id, whether it is held out and its number of tokens; the block's sorted word
    hashes with training counts; the tokens as numbers of those words. Each document ends with an end token."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash
        from pyspark import TaskContext

        part, n_blocks = TaskContext.get().partitionId(), 0
        names = ["block", "ids", "held", "sizes", "stream", "words", "n_train"]
        ids, out, sizes, local, tokens = [], [], [], {b"": 0}, []

        def block() -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, local), np.uint64, len(local))
            words, rank = np.unique(hashes, return_inverse=True)
            stream = rank[np.array(tokens, np.int64)].astype("<u4")
            train = np.repeat(~np.array(out, bool), np.array(sizes))
            counts = np.bincount(stream[train], minlength=len(words)).astype("<u4")
            cells = [[(part << 32) + n_blocks], [pa.array(ids, id_type)], [out], [sizes], [_pack(stream)], [_pack(words.astype("<u8"), counts)], [int(train.sum())]]
            kinds = [pa.int64(), pa.list_(id_type), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c if k != pa.list_(id_type) else [c[0].to_pylist()], k) for c, k in zip(cells, kinds)], names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(id).type
            for rows in slices(batch, text):
                held_out = rows.column("_held").to_pylist()
                for i, h, t in zip(rows.column(id).to_pylist(), held_out, raw(rows, text)):
                    words = t.lower().split()
                    tokens.extend([local.setdefault(w, len(local)) for w in words])
                    tokens.append(0)
                    ids.append(i)
                    out.append(bool(h))
                    sizes.append(len(words) + 1)
                    if len(tokens) >= block_tokens:
                        yield block()
                        n_blocks += 1
                        ids, out, sizes, local, tokens = [], [], [], {b"": 0}, []
        if ids:
            yield block()

    rows = docs.select(id, *({text} - {id}), F.coalesce(held, F.lit(False)).alias("_held"))
    return rows.mapInArrow(run, BLOCK.format(kind))


def _mixed(x):
    """A 64-bit mix, to deal numbers to shards."""
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _pairs(words, stream, n_shards: int, hot):
    """A block's distinct bigrams in shard, context and word order: (shard, context, word, place of each token's bigram).
    A document's first word follows an end token."""
    import numpy as np

    end = int(np.searchsorted(words, np.uint64(_END)))
    before = np.r_[end, stream[:-1]].astype(np.int64)
    code, place = np.unique(before * len(words) + stream, return_inverse=True)
    u, w = words[code // len(words)] & np.uint64(W48), words[code % len(words)] & np.uint64(W48)
    shard = (_mixed(u ^ np.where(np.isin(u, hot), _mixed(w), np.uint64(0))) % np.uint64(n_shards)).astype(np.int64)
    order = np.lexsort((w, u, shard))
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return shard[order], u[order], w[order], back[place]


_END = 0xEF46DB3751D8E999  # XXH64 of no bytes: no word has it but by chance


def _ask(blocks_: DataFrame, n_shards: int, hot: list[int]) -> DataFrame:
    """(level, shard, block, ask): a block's distinct words and bigrams with their training counts, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for block, stream, words, held, sizes in zip(*(batch.column(c).to_pylist() for c in ("block", "stream", "words", "held", "sizes"))):
                (stream,), (words, counts) = _unpack(stream), _unpack(words)
                out = []
                shard = (words >> np.uint64(40)).astype(np.int64) % n_shards
                for s in np.unique(shard):
                    out.append((1, int(s), _pack(words[shard == s], counts[shard == s])))
                shard, u, w, place = _pairs(words, stream, n_shards, np.array(hot, np.uint64))
                train = np.repeat(~np.array(held, bool), np.array(sizes))
                n = np.bincount(place[train], minlength=len(u)).astype("<u4")
                for s in np.unique(shard):
                    a, b = np.searchsorted(shard, [s, s + 1])
                    own = np.flatnonzero(np.r_[True, u[a + 1 : b] != u[a : b - 1]])
                    out.append((2, int(s), _pack(_pack48(u[a:b][own]), np.diff(np.r_[own, b - a]).astype("<u4"), _pack48(w[a:b]), n[a:b])))
                for at in range(0, len(out), 64):
                    level, shards, data = zip(*out[at : at + 64])
                    yield pa.RecordBatch.from_arrays([pa.array(level, pa.int32()), pa.array(shards, pa.int64()), pa.array([block] * len(data), pa.int64()), pa.array(data, pa.binary())], ["level", "shard", "block", "ask"])

    return blocks_.select("block", "stream", "words", "held", "sizes").mapInArrow(run, "level int, shard long, block long, ask binary")


def _answer(asks: DataFrame, mu: float, totals: dict[int, int], train: int) -> DataFrame:
    """(level, shard, block, answer, n): each shard merges all blocks' counts, builds its level and answers each block."""

    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        level, shard = table.column("level")[0].as_py(), table.column("shard")[0].as_py()
        blocks_ = table.column("block").to_pylist()
        asks = [_unpack(x.as_py()) for x in table.column("ask")]
        if level == 1:
            keys, at = np.unique(np.concatenate([a[0] for a in asks]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([a[1] for a in asks])).astype("<i8")
            del at
            seen = counts > 0
            trie, distinct = Unigrams(keys[seen], counts[seen], train).mapped(), int(seen.sum())
            answers = [_pack(*trie.ask(a[0])) for a in asks]
        else:
            rows = [(np.repeat(_unpack48(u), n), _unpack48(w), c) for u, n, w, c in asks]
            del asks
            seen = [tuple(x[r[2] > 0] for x in r) for r in rows]
            u, w, c = (np.concatenate([s[i] for s in seen]) for i in range(3))
            del seen
            order = np.lexsort((w, u))
            u, w, c = u[order], w[order], c[order].astype(np.int64)
            new = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])]) if len(u) else np.zeros(0, np.int64)
            trie = Level(u[new], w[new], np.add.reduceat(c, new) if len(new) else c, mu, totals).mapped()
            del u, w, c, order
            distinct, answers = len(new), [_pack(*trie.ask(a, b)) for a, b, _ in rows]
        n = len(blocks_)
        return pa.table({"level": pa.array([level] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int64()), "block": pa.array(blocks_, pa.int64()), "answer": pa.array(answers, pa.binary()), "n": pa.array([distinct] * n, pa.int64())})

    return asks.groupBy("level", "shard").applyInArrow(run, "level int, shard long, block long, answer binary, n long")


def _hot(blocks_: DataFrame, share: float) -> list[int]:
    """The 48-bit words with at least `share` of a block's training tokens in some block, and then of all; 1 / share at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for words in batch.column("words").to_pylist():
                words, counts = _unpack(words)
                top = counts >= share / 2 * max(1, counts.sum())
                yield pa.RecordBatch.from_arrays([pa.array((words[top] & np.uint64(W48)).astype(np.int64)), pa.array(counts[top].astype(np.int64))], ["u", "n"])

    total = blocks_.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("n")).first().n
    found = blocks_.select("words").mapInArrow(run, "u long, n long").groupBy("u").agg(F.sum("n").alias("n"))
    return sorted(r.u for r in found.filter(F.col("n") >= share * max(total, 1)).orderBy(F.desc("n"), "u").limit(int(1 / share)).collect())


def _totals(blocks_: DataFrame, hot: list[int]) -> dict[int, int]:
    """Training counts of a few words, exactly."""
    if not hot:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for words in batch.column("words").to_pylist():
                words, counts = _unpack(words)
                mine = words & np.uint64(W48)
                top = np.isin(mine, np.array(hot, np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(mine[top].astype(np.int64)), pa.array(counts[top].astype(np.int64))], ["u", "n"])

    return {r.u: r.n for r in blocks_.select("words").mapInArrow(run, "u long, n long").groupBy("u").agg(F.sum("n").alias("n")).collect()}


def score(docs: DataFrame, held: Column, id: str = "doc_id", text: str = "text", mu: float = MU, block_tokens: int = BLOCK_TOKENS, shard_bytes: int = SHARD_BYTES, hot_share: float | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row, learned from rows that aren't held out.

    Null texts are empty: the end token alone. Where every row is held out nothing is known and all words are alike. A
    null id is not held out. Repeated rows count each. An empty table gives an empty result.
    """
    kind = docs.schema[id].dataType.simpleString()
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first().n
    n_shards = max(1, -(-int(size) // shard_bytes))
    made = staged(blocks(docs, id, text, held, block_tokens), "blocks")
    hot = _hot(made, hot_share or max(LEAST_HOT, 1 / (4 * n_shards))) if n_shards > 1 else []
    train = int(made.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("n")).first().n)
    answers = staged(_answer(_ask(made, n_shards, hot), mu, _totals(made, hot), train), "answers")
    distinct = int(answers.filter("level = 1").groupBy("shard").agg(F.max("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n)

    def run(block: pa.Table, said: pa.Table) -> pa.Table:
        import numpy as np

        (stream,), (words, _) = _unpack(block.column("stream")[0].as_py()), _unpack(block.column("words")[0].as_py())
        parts: dict[int, list] = {1: [], 2: []}
        for level, shard, answer in sorted(zip(said.column("level").to_pylist(), said.column("shard").to_pylist(), said.column("answer").to_pylist()), key=lambda x: x[:2]):
            parts[level].append((shard, _unpack(answer)))
        shard = (words >> np.uint64(40)).astype(np.int64) % n_shards
        counts, fine = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for s, (c, q) in parts[1]:
            counts[shard == s], fine[shard == s] = c, q
        norm = train + 0.5 * (distinct + 1)
        one = (counts + 0.5) / norm
        own = np.where(fine > 0, 10.0 ** (-FINE * (fine - 1)) * max(train, 1), 0.5) / norm  # the trie's; unseen words have half a count
        place = _pairs(words, stream, n_shards, np.array(hot, np.uint64))[3]
        q, weight = (np.concatenate([a[i] for _, a in parts[2]]) for i in range(2))
        model = np.log10(restored(q[place]) + restored(weight[place]) * own[stream])
        sizes = np.array(block.column("sizes")[0].as_py(), np.int64)
        begin = np.r_[0, np.cumsum(sizes)[:-1]]
        sums = [np.add.reduceat(x, begin) for x in ((counts > 0).astype(np.int64)[stream], np.log10(one)[stream], model)]
        n = len(sizes)
        return pa.table({"id": block.column("ids").combine_chunks().values, "held_out": pa.array(block.column("held")[0].as_py(), pa.bool_()), "n_tokens": pa.array(sizes), "n_known": pa.array(sums[0]), "train_tokens": pa.array(np.full(n, train)), "base_score": pa.array(sums[1]), "score": pa.array(sums[2])})

    out = made.select("block", "ids", "held", "sizes", "stream", "words").groupBy("block").cogroup(answers.select("block", "level", "shard", "answer").groupBy("block")).applyInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id)
