import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.operators import diff, text


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def people(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id bigint, name string")


OLD = ((1, "alice"), (2, "bob"))


@pytest.mark.parametrize(
    "old, new, expected",
    [
        (OLD, (*OLD, (3, "charlie")), [('["3"]', "added", None, "charlie")]),
        ((*OLD, (3, "charlie")), OLD, [('["3"]', "removed", "charlie", None)]),
        (OLD, ((1, "alice"), (2, "bobby")), [('["2"]', "modified", "bob", "bobby")]),
        (OLD, OLD, []),
        ((), OLD, [('["1"]', "added", None, "alice"), ('["2"]', "added", None, "bob")]),
        ((), (), []),
    ],
)
def test_keyed(spark, old, new, expected):
    found = diff.diff_rows_by_key(people(spark, *old), people(spark, *new), ["id"])
    assert rows(found.select("key", "change_type", "old_values.name", "new_values.name"), "key") == expected


@pytest.mark.parametrize("old, new", [(((1, "a"), (1, "b")), OLD), (OLD, ((1, "a"), (1, "b")))])
def test_duplicate_keys_are_an_error(spark, old, new):
    with pytest.raises(diff.DuplicateKeyError):
        diff.diff_rows_by_key(people(spark, *old), people(spark, *new), ["id"])


def test_nan_null_and_numbers_of_other_types(spark):
    old = spark.createDataFrame([(1, float("nan"), 1), (2, None, 1), (3, 1.5, 0)], "id int, x double, y int")
    new = spark.createDataFrame([(1, None, 1.0), (2, float("nan"), 1.0), (3, 1.5, 0.5)], "id int, x double, y double")
    found = diff.diff_rows_by_key(old, new, ["id"])
    assert rows(found.select("id", "change_type"), "id") == [(3, "modified")]


def test_null_keys_match_and_new_columns_modify_nothing(spark):
    old = spark.createDataFrame([(None, "a")], "id int, name string")
    new = spark.createDataFrame([(None, "a", 5)], "id int, name string, age int")
    assert diff.diff_rows_by_key(old, new, ["id"]).isEmpty()
    assert rows(diff.diff_schema(old, new), "column") == [("age", None, "int", "added")]


def test_keys_order_as_text_and_truncate(spark):
    old = people(spark, *[(i, "x") for i in range(12)])
    new = people(spark, *[(i, "y") for i in range(12)])
    changes = diff.diff_rows_by_key(old, new, ["id"])
    assert [r["key"] for r in diff.truncated(changes, 4).collect()] == ['["0"]', '["10"]', '["11"]', '["1"]'] or [r["key"] for r in diff.truncated(changes, 4).collect()] == sorted(f'["{i}"]' for i in range(12))[:4]
    assert diff.is_truncated(old, new, changes, ["id"], 4)
    assert not diff.is_truncated(old, new, changes, ["id"], 12)


def test_rows_of_one_key_truncate_alike_in_any_order(spark):
    old = people(spark, (1, "a"))
    new = [people(spark, *pairs).coalesce(1) for pairs in (((1, "b"), (1, "c"), (1, "d")), ((1, "d"), (1, "c"), (1, "b")))]
    shown = [[tuple(r["new_values"]) for r in diff.truncated(diff.diff_rows_by_key(old, n, ["id"], check=False), 1).collect()] for n in new]
    assert shown[0] == shown[1]


def test_an_unchanged_key_after_the_last_change_truncates(spark):
    old = people(spark, (1, "a"), (2, "b"), (3, "c"))
    new = people(spark, (1, "x"), (2, "y"), (3, "c"))
    changes = diff.diff_rows_by_key(old, new, ["id"])
    assert diff.is_truncated(old, new, changes, ["id"], 2)


def test_positional(spark):
    found = diff.diff_rows_positional(people(spark, *OLD), people(spark, (1, "alice"), (2, "bobby"), (3, "c")), ["id"])
    assert rows(found.select("position", "change_type"), "position") == [(1, "modified"), (2, "added")]


def test_reorder_only(spark):
    a = people(spark, *OLD)
    assert diff.reorder_only(a, a)
    assert diff.reorder_only(a, people(spark, *OLD[::-1]))
    assert not diff.reorder_only(a, people(spark, *OLD, *OLD))
    assert not diff.reorder_only(a, a.withColumnRenamed("name", "other"))


def test_whole_tables(spark):
    a, b = people(spark, *OLD), people(spark, (1, "alice"), (2, "x"))
    assert diff.diff_tables(None, a)["change_type"] == "added"
    assert diff.diff_tables(a, None)["change_type"] == "removed"
    assert diff.diff_tables(a, a)["reorder_only"]
    assert diff.diff_tables(a, b, keys=["id"])["rows"].count() == 1
    with pytest.raises(ValueError):
        diff.diff_tables(a, b, keys=["nope"])
    with pytest.raises(ValueError):
        diff.diff_tables(a, b)


def test_hash_diff_takes_null_as_absent(spark):
    kind = "path string, hash string"
    old = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3"), ("d", None)], kind)
    new = spark.createDataFrame([("a", "2"), ("b", "2"), ("c", None), ("d", None)], kind)
    assert rows(diff.diff_hashes(old, new), "path") == [("a", "1", "2", "modified"), ("b", None, "2", "added"), ("c", "3", None, "removed")]


def test_two_levels_take_null_as_present(spark):
    kind = "path string, key string, value double"
    old = spark.createDataFrame([("m", "acc", None), ("m", "loss", 0.5)], kind)
    new = spark.createDataFrame([("m", "acc", 0.9), ("m", "f1", 0.1)], kind)
    assert rows(diff.diff_metrics(old, new).select("key", "old", "new", "change_type"), "key") == [("acc", None, 0.9, "modified"), ("f1", None, 0.1, "added"), ("loss", 0.5, None, "removed")]


def test_params_compare_as_json(spark):
    kind = "stage string, key string, value_json string"
    old = spark.createDataFrame([("s", "a", "1"), ("s", "b", "true")], kind)
    new = spark.createDataFrame([("s", "a", "1.0"), ("s", "b", "true")], kind)
    assert rows(diff.diff_params(old, new).select("key", "change_type"), "key") == [("a", "modified")]


def test_dependency_manifests_count(spark):
    kind = "stage string, path string, hash string, manifest array<struct<relpath: string, hash: string>>"
    old = spark.createDataFrame([("s", "d", "h", [("x", "1")])], kind)
    new = spark.createDataFrame([("s", "d", "h", [("x", "2")])], kind)
    assert rows(diff.diff_deps(old, new).select("path", "change_type"), "path") == [("d", "modified")]


def test_summary_text(spark):
    counts = spark.createDataFrame([(1, 0, 2)], "n_added long, n_removed long, n_modified long")
    assert text.summary_text(counts).first()["text"] == "+1 added, ~2 modified"
    assert text.format_table(counts, "md").startswith("| n_added")
    assert text.format_table(counts.limit(0), empty="nothing") == "nothing"


tables = st.dictionaries(st.integers(0, 6), st.one_of(st.none(), st.sampled_from(["a", "b"])), max_size=6)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(tables, tables)
def test_properties(spark, a, b):
    left, right = (spark.createDataFrame(list(t.items()), "id int, name string") for t in (a, b))
    forward = {r["id"]: r for r in diff.diff_rows_by_key(left, right, ["id"]).collect()}
    backward = {r["id"]: r for r in diff.diff_rows_by_key(right, left, ["id"]).collect()}
    mirror = {"added": "removed", "removed": "added", "modified": "modified"}
    assert {k: mirror[r["change_type"]] for k, r in forward.items()} == {k: r["change_type"] for k, r in backward.items()}
    applied = dict(a)
    for k, r in forward.items():
        if r["change_type"] == "removed":
            del applied[k]
        else:
            applied[k] = r["new_values"]["name"]
    assert applied == b


def test_columns_with_nested_values(spark):
    old = spark.sql("select 1 id, array(1, 2) x union all select 2, array(3)")
    new = spark.sql("select 1 id, array(1, 2) x union all select 2, array(4)")
    assert rows(diff.diff_rows_by_key(old, new, ["id"]).select("id", "change_type"), "id") == [(2, "modified")]


def test_clean_rows(spark):
    assert diff.clean_rows(spark.createDataFrame([(float("nan"),)], "x double")).where(F.col("x").isNull()).count() == 1
