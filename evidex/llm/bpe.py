"""Byte-pair encoding and decoding, merges chosen by a segment tree over the ranks of adjacent pairs.

A word's symbols are the leaves of the tree, each with the key of the pair that it and its right neighbour form: the
merge's rank, then the place. The root holds the least key, so it names the leftmost of the lowest-rank merges. A merge
changes three leaves, the merged pair's, its left neighbour's and that of the symbol that went, each in logarithmic time;
when the root is empty, no pair can merge. A word of n symbols so takes O(n log n), however long it is: a text without
blanks is one word.

The vocabulary, the merges, the special tokens and the splitting are those of a public tokenizer file. Texts in the Latin
scripts are normalised and split here; any other text by the normaliser and splitter that the file declares, as Unicode
versions differ beyond. Words come back often, so each Python worker keeps the ids of those of bounded length in a bounded
memory. The rows stay where they are: there is no shuffle, and a lost task is just run again.
"""

from __future__ import annotations

import itertools
import json
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import schema_of, slices

#: The longest word kept, and how many.
KEPT_LENGTH, KEPT_WORDS = 40, 1 << 18
NONE = 1 << 62


def default_file() -> str:
    """The public vocabulary with word ends."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Merges:
    """The merges of a vocabulary: which pairs of ids merge, in what order, into what."""

    def __init__(self, pairs: Iterable[tuple[int, int, int]]):
        """`pairs`: (left, right, merged), the lowest rank first; of equal pairs the last counts. Ids are below 2^32."""
        self.made: list[int] = []
        self.rank: dict[int, int] = {}
        for n, (left, right, merged) in enumerate(pairs):
            self.rank[left << 32 | right] = n
            self.made.append(merged)

    def apply(self, ids: list[int]) -> list[int]:
        """`ids` after every merge, the leftmost of the lowest rank first. The tree is a flat list: node k has the children
        2k and 2k + 1, and the leaf of place p is node `size` + p."""
        n, rank, made = len(ids), self.rank.get, self.made
        if n < 2:
            return ids
        bits, size = n.bit_length(), 1 << (n - 2).bit_length()
        place = (1 << bits) - 1
        found = [rank(a << 32 | b) for a, b in itertools.pairwise(ids)]
        tree = [NONE] * size + [NONE if r is None else r << bits | at for at, r in enumerate(found)] + [NONE] * (size - n + 1)
        for at in range(size - 1, 0, -1):
            a, b = tree[2 * at], tree[2 * at + 1]
            tree[at] = a if a < b else b
        ids = [*ids]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while (least := tree[1]) != NONE:
            at = least & place
            new = ids[at] = made[least >> bits]
            gone = after[at]
            ids[gone] = -1
            right, left = after[gone], before[at]
            after[at] = right
            changed = []
            if gone < n - 1:
                changed.append((gone, NONE))
            if right < n:
                before[right] = at
                r = rank(new << 32 | ids[right])
                changed.append((at, NONE if r is None else r << bits | at))
            else:
                changed.append((at, NONE))
            if left >= 0:
                r = rank(ids[left] << 32 | new)
                changed.append((left, NONE if r is None else r << bits | left))
            for leaf, key in changed:
                node = leaf + size
                if tree[node] == key:
                    continue
                tree[node] = key
                while node > 1:
                    other = tree[node ^ 1]
                    node >>= 1
                    key = key if key < other else other
                    if tree[node] == key:
                        break
                    tree[node] = key
        return [i for i in ids if i >= 0]


class _Words(dict):
    """Ids of words, packed. Words of bounded length are remembered, the last `KEPT_WORDS` to twice as many of them."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        packed = self.old.get(word)
        if packed is None:
            ids = self.encode(word)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = packed
        return packed


class Codec:
    """A tokenizer file's encoding, without added special tokens, and decoding, special tokens included.

    A text that holds a special token's string has that token there, as in the library. Ids outside the vocabulary are
    skipped in decoding, which joins tokens by blanks, since the file declares no decoder.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        plain = {"continuing_subword_prefix": None, "dropout": None, "unk_token": None, "byte_fallback": False, "ignore_merges": False}
        if spec["decoder"] is not None or model["type"] != "BPE" or any((model.get(k) or v) != v for k, v in plain.items()):
            raise ValueError(f"{path} is not a plain byte-pair vocabulary with word ends")
        vocabulary = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids = vocabulary
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.special.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = Merges((vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs)
        file = Tokenizer.from_file(path)
        self.normalise, self.split = file.normalizer.normalize_str, file.pre_tokenizer.pre_tokenize_str
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.parts = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.other = regex.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ‐-‧‰-⁞€]")
        self.letter = dict(zip(range(256), _byte_letters()))
        self.plain = _Words(lambda word: self._merged(word.encode().decode("latin-1").translate(self.letter)))
        self.mapped = _Words(self._merged)

    def _merged(self, letters: str) -> list[int]:
        """Ids of one word, given as a letter a byte; a letter outside the vocabulary is skipped."""
        symbols = [*letters[:-1], letters[-1] + self.end]
        return self.merges.apply([self.ids[s] for s in symbols if s in self.ids])

    def encode(self, text: str) -> bytes:
        """Ids, packed as little-endian unsigned 32-bit integers."""
        parts = self.parts.split(text) if self.parts and self.parts.search(text) else [text]
        out: list[bytes] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part.isascii() or not self.other.search(part):
                out += map(self.plain.__getitem__, self.pattern.findall(part.lower()))
            else:
                out += [self.mapped[w] for w, _ in self.split(self.normalise(part))]
        return b"".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        """The ids' tokens, joined by blanks."""
        try:
            return " ".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def _byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: itself where it is printable, else the next from U+0100 on."""
    fresh = iter(range(0x100, 0x200))
    return [chr(b) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b else chr(next(fresh)) for b in range(256)]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a Python worker and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, text: str = "text", out: str = "ids", keep: list[str] | None = None, packed: bool = False, path: str | None = None) -> DataFrame:
    """`keep` (else all columns but the text) and the text's ids: an array of integers, or packed as binary, four bytes an id.

    A null text is empty and has no ids. A column that is called like `out` gives way. Repeated rows are encoded each; an
    empty table gives an empty result. Order and number of rows stay.
    """
    path = path or default_file()
    keep = [c for c in (docs.columns if keep is None else keep) if c != out and (keep is not None or c != text)]
    kind = "binary" if packed else "array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        own = codec(path)
        for batch in batches:
            for rows in slices(batch, text):
                made = [own.encode(t or "") for t in rows.column(text).to_pylist()]
                if packed:
                    ids = pa.array(made, pa.binary())
                else:
                    ends = np.cumsum([0, *(len(x) // 4 for x in made)]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(made), "<i4")))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), ids], [*keep, out])

    return docs.select(*keep, *({text} - {*keep})).mapInArrow(run, ", ".join(x for x in (schema_of(docs, *keep), f"`{out}` {kind}") if x))


def decode(rows: DataFrame, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """`keep` (else all columns) and the text of an array of ids or of packed ids.

    Null ids give an empty text; ids outside the vocabulary are skipped. A column that is called like `out` gives way.
    """
    path = path or default_file()
    keep = [c for c in (rows.columns if keep is None else keep) if c != out]
    packed = rows.schema[ids].dataType.simpleString() == "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        own = codec(path)
        for batch in batches:
            column = batch.column(ids)
            lists = (np.frombuffer(x.as_buffer(), "<u4").tolist() if x.is_valid else [] for x in column) if packed else (x.as_py() or [] for x in column)
            texts = pa.array([own.decode(x) for x in lists], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), texts], [*keep, out])

    return rows.select(*keep, *({ids} - {*keep})).mapInArrow(run, ", ".join(x for x in (schema_of(rows, *keep), f"`{out}` string") if x))
