from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerloom.operators import delivery

SCHEMA = "row_id long, id string, model string, arm string, eval_set string, ts timestamp, extra string, _k0 string, _tie int"
T0 = datetime(2026, 1, 1)


def rows(*items):
    return [(i, a, m, "cot", "dev", None if t is None else T0 + timedelta(hours=t), "x", "clash", 7) for i, a, m, t in items]


def test_earliest_stays_and_null_time_is_last(spark):
    df = spark.createDataFrame(rows((1, "a", "x/y.z", None), (2, " A ", "x--y-z", 5), (3, "a ", "X/Y.Z", 4), (4, "a", "x/y.z", 4), (5, "b", "m", None), (6, "b", "m", None)), SCHEMA)
    assert sorted(r.row_id for r in delivery.surplus_rows(df).collect()) == [1, 2, 4, 6]
    kept = delivery.deduplicate(df).orderBy("row_id").collect()
    assert [r.row_id for r in kept] == [3, 5] and kept[0].id == "a " and kept[0]._k0 == "clash"


def test_nulls_and_repeats(spark):
    df = spark.createDataFrame(rows((1, None, None, 1), (2, None, None, 2), (3, "a", "m", 1), (3, "a", "m", 1), (3, "a", "m", 1), (None, "a", "m", 1), (None, "c", "m", None)), SCHEMA)
    assert sorted((r.row_id for r in delivery.surplus_rows(df).collect()), key=str) == [2, 3, 3, None]
    assert sorted((r.row_id for r in delivery.deduplicate(df).collect()), key=str) == [1, 3, None]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert delivery.surplus_rows(df).count() == delivery.deduplicate(df).count() == delivery.new_messages(df, df).count() == 0


def test_new_messages(spark):
    old = spark.createDataFrame(rows((1, "a", "m", 9), (2, None, "m", 1)), SCHEMA)
    new = spark.createDataFrame(rows((3, "A", "M", 1), (4, None, "m", 1), (5, "c", "m", 3), (6, "c", "m", 2)), SCHEMA)
    assert [r.row_id for r in delivery.new_messages(new, old).collect()] == [6]


def test_one_key_holds_a_third(spark):
    df = spark.range(3000).selectExpr("id as row_id", "if(id % 3 = 0, 'hot', cast(id as string)) as id", "'m' as model", "'a' as arm", "'e' as eval_set", "cast(null as timestamp) as ts")
    assert delivery.surplus_rows(df).count() == 999


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "A ", "b", None]), st.sampled_from(["m", "M", None]), st.one_of(st.none(), st.integers(0, 3))), max_size=12))
def test_brute_force(spark, items):
    df = spark.createDataFrame(rows(*[(i, a, m, t) for i, (a, m, t) in enumerate(items)]), SCHEMA)
    best = {}
    for i, (a, m, t) in enumerate(items):
        key = (a and a.strip().lower(), m and m.lower())
        best[key] = min(best.get(key, (9, 9, 10**9)), (t is None, t or 0, i))
    kept = {v[2] for v in best.values()}
    assert {r.row_id for r in delivery.surplus_rows(df).collect()} == set(range(len(items))) - kept
    assert {r.row_id for r in delivery.deduplicate(df).collect()} == kept


def test_lookup_join(spark):
    from ledgerloom.operators.skew import hot_keys, lookup_join

    left = spark.range(1000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then cast(id as string) end as k")
    right = spark.createDataFrame([("hot", 1), ("1", 2), ("x", 3)], "k string, v int")
    assert hot_keys(left, "k") == ["hot"]
    got = lookup_join(left, right, "k")
    assert got.count() == 1000 and got.where("v = 1").count() == 334 and got.where("v = 2").count() == 1 and got.where("v is null").count() == 665
    assert lookup_join(left.limit(0), right, "k").count() == 0


def test_shared_dir_is_local_only_in_tests(spark):
    from ledgerloom.session import durable, shared_dir

    assert shared_dir(spark)
    assert durable(spark.range(5), "t").count() == 5


@pytest.mark.parametrize("name", ["p5_found", "p5_kept"])
def test_registered(name):
    import __spark_entry__ as e

    assert name in e.queries() and name in e.oracle_sql()


def test_release_deletes_what_was_written(spark):
    from ledgerloom import session

    path = session.durable(spark.range(3), "gone").inputFiles()[0]
    session.release()
    assert not session._WRITTEN
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
