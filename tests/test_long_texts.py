"""Retrieval over texts longer than any prefix."""

import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from evidex.plans import QUERIES, retrieval


@pytest.fixture(scope="module")
def long_texts(tmp_path_factory):
    """Texts of 700 words of few sources: some share their beginning alone, some all but their beginning, some all."""
    top = tmp_path_factory.mktemp("long")
    rng = random.Random(4)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    head, tail, whole = new(250), new(450), new(700)
    bodies = [head + new(450) for _ in range(4)] + [new(250) + tail if k % 2 else new(90) + tail + tail[:160] for k in range(4)] + [whole[:-k] + new(k) for k in (1, 2, 150, 300)]
    texts = [" ".join(["alpha", *(["beta"] if k % 3 else []), *b]) for k, b in enumerate(bodies)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = {"doc_id": order, "text": [texts[k] for k in order], "lang": ["en"] * len(texts), "source": [f"s{k // 4}" for k in order], "n_chars": [len(texts[k]) for k in order]}
    pq.write_table(pa.table(docs), top / "documents.parquet")
    pq.write_table(pa.table({"item_id": [0, 1, 2], "text": ["alpha beta", "Alpha", "beta " + " ".join(tail[:30])]}), top / "benchmark.parquet")
    return str(top)


def test_diversified_by_whole_texts(spark, long_texts):
    docs = {r.doc_id: (r.source, set(re.findall("[a-z0-9]+", r.text.lower()))) for r in spark.read.parquet(f"{long_texts}/documents.parquet").collect()}
    lists = {}
    for r in sorted(retrieval.lexical(spark, long_texts).collect(), key=lambda r: r.lex_rank):
        lists.setdefault(r.query, []).append(r.id)
    want = set()
    for q, ids in lists.items():
        chosen, passed = [], []
        for i in ids:
            (s, w), of = docs[i], [c for c in chosen if docs[c][0] == docs[i][0]]
            alike = any(len(w & docs[c][1]) >= 0.75 * len(w | docs[c][1]) for c in of)
            (passed if alike or len(of) >= 3 or len(chosen) >= 8 else chosen).append(i)
        want |= {(q, i, k + 1) for k, i in enumerate((chosen + passed)[: max(8, len(chosen))])}
    assert {tuple(r) for r in QUERIES["r36_diversified"](spark, long_texts).collect()} == want
