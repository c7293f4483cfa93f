"""Byte-pair encoding against the tokenizers library, and merging against a plain search."""

import hashlib
import random
import time

import numpy as np
import pytest
from evidex.llm import bpe, queries
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_file())


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.default_file())


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


HARD = [
    "", " ", "\n\t", "a", "It's 12 o'clock, they'LL go", "ÀÉÎ ß ŉ İstanbul ΑΣ ΑΣ. σ", "été étés", "a\x1cb\x85c d", "中文字符 한국어 😀😀👍🏽",
    "<|endoftext|>", "a<|endoftext|><|startoftext|>b <|ENDOFTEXT|> <|endoftext", "!!!???...---", "x" * 5000, "ab" * 3000, "͸՘꟱ new letters", "'s's'S 't",
]


def test_hard_texts(library, codec):
    for text in HARD:
        got = ids(codec.encode(text))
        assert got == library.encode(text, add_special_tokens=False).ids, text[:40]
        assert codec.decode(got) == library.decode(got, skip_special_tokens=False)


def test_random_texts(library, codec):
    rng = random.Random(11)
    letters = "aabbcde eE'stłéİßǅ’ \n\t\x1c\x85 😀中文字ΑΣσ1٣<|endoftext|>́"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) + rng.choice(["", "<|endoftext|>", "É"])
        assert ids(codec.encode(text)) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_leftmost_lowest_rank():
    """Random merges over few letters, so that equal and overlapping pairs are common."""
    rng = random.Random(5)
    for _ in range(300):
        pairs, top = [], 3
        for _ in range(rng.randint(0, 8)):
            pairs.append((rng.randrange(top), rng.randrange(top), top))
            top += 1
        merges = bpe.Merges(pairs)
        want = word = [rng.randrange(3) for _ in range(rng.randint(0, 40))]
        rank = {(a, b): k for k, (a, b, _) in enumerate(pairs)}
        while True:
            found = [(rank[p], k) for k, p in enumerate(zip(want, want[1:])) if p in rank]
            if not found:
                break
            r, k = min(found)
            want = [*want[:k], pairs[r][2], *want[k + 2 :]]
        assert merges.apply(word) == want


def test_long_word_takes_little_more_than_its_length(codec):
    rng = random.Random(2)
    took = []
    for n in (20_000, 160_000):
        word = "".join(rng.choice("abcdefghijetaoin") for _ in range(n))
        start = time.perf_counter()
        codec.encode(word)
        took.append(time.perf_counter() - start)
    assert took[1] < took[0] * 8 * 4


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 10)
    words = bpe._Words(lambda w: [len(w)])
    for k in range(1000):
        assert words["x" * (k % 60)] == (k % 60).to_bytes(4, "little")
    assert len(words) <= 10 and len(words.old) <= 10


def test_rows(spark, library):
    """Null and repeated rows, clashing columns, arrays and packed ids, unknown ids."""
    rows = [(1, "It's <|endoftext|> ok", "x"), (None, None, None), (1, "It's <|endoftext|> ok", "x"), (2, "", "y"), (3, "日本語 " * 2000, "z")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids string")
    for packed in (False, True):
        out = bpe.encode(docs, packed=packed)
        assert out.columns == ["doc_id", "ids"]
        back = bpe.decode(out).collect()
        want = [library.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows]
        assert [ids(r.ids) if packed else r.ids for r in back] == want
        assert [r.decoded for r in back] == [library.decode(x, skip_special_tokens=False) for x in want]
    odd = spark.createDataFrame([(1, [5, 70000, 49407]), (2, None), (3, [])], "k int, ids array<int>")
    assert [r.decoded for r in bpe.decode(odd).collect()] == [library.decode([5, 70000, 49407], skip_special_tokens=False), "", ""]
    assert bpe.encode(docs.limit(0)).count() == 0


def test_query_against_the_library(spark, sf, library):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op11_bpe"](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(rows[r.doc_id], add_special_tokens=False).ids
        text = library.decode(want, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
