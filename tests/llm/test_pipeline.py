"""Each stage of the pipeline against a plain version, on its own input, and the whole against the stages."""

import corpus_pipeline as P
from evidex.llm import queries
from tokenizers import Tokenizer

from .test_decontaminate import tokens
from .test_simhash import slow_similar


def leaks(bench):
    windows = set()
    for _, t in bench:
        w = tokens(t)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
    sizes = {len(w) for w in windows}

    def leaked(text):
        w = tokens(text)
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    return leaked


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = leaks(bench)
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    after = {}
    now = docs
    for name, stage in P.STAGES[:-1]:
        now = P.staged(stage(spark, now, sf), name)
        assert now.columns == columns
        after[name] = {r.doc_id: r.text for r in now.collect()}
    rejected = {r.doc_id for r in queries.op2_toxicity(spark, sf).collect() if r.predicted}
    assert set(after["toxicity"]) == ids - rejected and rejected
    kept = {r.doc_id for r in queries.quality.judged(docs.filter(docs.doc_id.isin(list(after["toxicity"])))).filter("kept").collect()}
    assert set(after["quality"]) == kept
    order = sorted(after["quality"])
    root = slow_similar([after["quality"][i] for i in order])
    assert set(after["near_dedup"]) == {min(order[j] for j in range(len(order)) if root[j] == r) for r in set(root)}
    assert set(after["decontaminate"]) == {i for i, t in after["near_dedup"].items() if not leaked(t)}
    slow = Tokenizer.from_file(queries.packing.default_files()[0])
    want = {i: len(slow.encode(t, add_special_tokens=False).ids) + 1 for i, t in after["decontaminate"].items()}
    got = {}
    for r in P.run(spark, sf).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
