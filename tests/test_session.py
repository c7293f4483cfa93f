from evidex import session


def test_staged_tables_are_kept_until_discarded(spark, tmp_path):
    df = session.staged(spark.range(5).selectExpr("id", "CAST(NULL AS STRING) AS s"), "t")
    assert df.count() == 5 and df.schema["s"].dataType.simpleString() == "string"
    assert session.staging(spark).startswith(session.shared_dir(spark))
    session.discard_staged(spark)
    empty = session.staged(spark.range(0), "none")
    assert empty.count() == 0


def test_scratch_deletes_what_is_not_kept(spark):
    import os

    with session.scratch(spark) as keep:
        a, b = session.staged(spark.range(3), "a"), session.staged(spark.range(4), "b")
        keep(b)
    paths = [x.staged_path.removeprefix("file://") for x in (a, b)]
    assert [os.path.exists(p) for p in paths] == [False, True] and b.count() == 4
    session.discard(b)
    assert not os.path.exists(paths[1])


def test_scopes_nest(spark):
    with session.scratch(spark) as keep:
        with session.scratch(spark) as inner:
            a = inner(session.staged(spark.range(2), "a"))
            session.staged(spark.range(2), "gone")
        b = keep(session.staged(a, "b"))
    assert b.count() == 2 and session._made == []
