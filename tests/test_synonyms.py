"""Declared synonyms beside letters that are not ASCII, against the query's SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from evidex.plans import ORACLES, QUERIES


def test_words_beside_letters_with_marks(spark, tmp_path):
    texts = ["En dießbe", "Die\u00fcber", "ädie", "the\u0301", "DİE", "DİE artİkel", "Kelvin the artiKel die", "die_ athe", "die.", "the definite", "le die9", "", None]
    n = len(texts)
    pq.write_table(pa.table({"conv_id": range(n), "turn": [0] * n, "role": ["user"] * n, "text": texts}), tmp_path / "conversations.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    want = sorted(db.execute(ORACLES["r03_synonyms"]).fetchall())
    assert [k for k, _, added in want if "artikel" in added] == [0, 1, 2, 4, 8] and [k for k, _, added in want if "definite" in added] == [3, 6]
    assert sorted((r.conv_id, r.turn, r.added) for r in QUERIES["r03_synonyms"](spark, str(tmp_path)).collect()) == want
