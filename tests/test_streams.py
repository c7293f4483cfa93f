"""Streams over folders of many files, in any order of time, against the queries' SQL."""

import random
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from evidex.plans import ORACLES, QUERIES

from .test_queries import plain


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """40 files of 30 hours each, together 50 days, named in random order of time."""
    top = tmp_path_factory.mktemp("many")
    folder = top / "events.parquet"
    folder.mkdir()
    rng = random.Random(3)
    order = list(range(40))
    rng.shuffle(order)
    for name, k in enumerate(order):
        ts = [datetime(2024, 1, 1) + timedelta(seconds=k * 108000 + rng.random() * 108000) for _ in range(60)]
        rows = {"event_id": [k * 60 + i for i in range(60)], "ts": ts, "user_id": [rng.randrange(4) for _ in ts], "event_type": [rng.choice("ab") for _ in ts], "value": [rng.randrange(10000) / 100 for _ in ts], "props": ["{}"] * 60}
        pq.write_table(pa.table(rows), folder / f"{name:03}.parquet")
    return str(top)


@pytest.mark.parametrize("name", ["s_daily_window", "s_dedup", "s_sessions"])
def test_many_files_in_random_order(spark, many, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{many}/events.parquet/*.parquet'")
    cursor = db.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = sorted([plain(v) for v in r] for r in cursor.fetchall())
    assert want and sorted([plain(r[c]) for c in columns] for r in QUERIES[name](spark, many).collect()) == want


def test_queue_over_batches(spark, tmp_path):
    """Events in several batches give the transitions of one: timers fire between batches, later events put them off."""
    import random
    from datetime import datetime, timedelta

    from evidex.streaming import queue

    rng = random.Random(12)
    start = datetime(2024, 1, 1)
    at = sorted(rng.randrange(40 * 3600) for _ in range(400))
    rows = [(k, rng.randrange(6), start + timedelta(seconds=t), rng.choice(["start", "start", "done", "fail", "fail", None])) for k, t in enumerate(at)]
    rows.append((999, 77, start + timedelta(hours=60), None))  # moves the watermark past all timers
    kind = "id long, job long, ts timestamp, kind string"
    want = []
    for job in {r[1] for r in rows}:
        n, since, mine = 0, None, [r for r in rows if r[1] == job]
        for _, _, ts, what in [*mine, (0, job, datetime(2030, 1, 1), "end")]:
            if since and ts > since + timedelta(hours=1):
                want.append((job, since + timedelta(hours=1), "STUCK", n, None))
            since = ts if what == "start" else None
            if what == "done":
                n = 0
            elif what == "fail":
                n += 1
                want.append((job, ts, "DEAD" if n >= 3 else "QUEUED", n, None if n >= 3 else 30 * 2 ** (n - 1)))
    before = spark.conf.get(queue.STORE[0], None)
    spark.conf.set(*queue.STORE)
    try:
        for parts in (1, 4):
            folder = f"file://{tmp_path}/{parts}"
            size = -(-len(rows) // parts)
            for k in range(parts):
                spark.createDataFrame(rows[k * size : (k + 1) * size], kind).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
            moves = queue.transitions(stream, "job", "ts", "kind", "id")
            run = moves.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
            run.awaitTermination()
            got = sorted((tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()), key=repr)
            assert got == sorted(want, key=repr)
    finally:
        if before is None:
            spark.conf.unset(queue.STORE[0])
        else:
            spark.conf.set(queue.STORE[0], before)


def test_sessions_just_a_gap_apart(spark, tmp_path):
    """Two events exactly 30 minutes apart are one session, on both sides; a microsecond more and they are two."""
    from datetime import datetime, timedelta

    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq
    from evidex.plans import ORACLES, QUERIES

    start = datetime(2024, 1, 1)
    half = timedelta(minutes=30)
    rows = [(1, start), (1, start + half), (2, start), (2, start + half + timedelta(microseconds=1)), (3, start + timedelta(days=2))]
    n = len(rows)
    pq.write_table(pa.table({"event_id": range(n), "ts": pa.array([t for _, t in rows], pa.timestamp("us")), "user_id": [u for u, _ in rows], "event_type": ["view"] * n, "value": [1.0] * n, "props": ["{}"] * n}), tmp_path / "events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = sorted(db.execute(ORACLES["s_sessions"]).fetchall())
    assert [(u, k) for u, _, k in want] == [(1, 2), (2, 1), (2, 1)]
    assert sorted(tuple(r) for r in QUERIES["s_sessions"](spark, str(tmp_path)).select("user_id", "started", "n").collect()) == want
