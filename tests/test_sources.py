import json

import pytest

from weftline.sources import readers, transfer, writers
from weftline.streaming import streams


def put(path, text):
    path.write_text(text)
    return str(path)


def test_tables(spark, tmp_path):
    csv = put(tmp_path / "a.CSV", 'id,note\n1,"two\nlines"\n2,x\n')
    assert readers.detect_format(csv) == "csv"
    assert readers.row_count(spark, csv) == 2
    assert readers.read_table(spark, csv).dtypes == [("id", "int"), ("note", "string")]
    assert readers.peek_schema(spark, put(tmp_path / "p.csv", "id,x\n1,a\n2,b\n")) == {"id": "int", "x": "string"}
    assert readers.row_count(spark, put(tmp_path / "h.csv", "id,note\n")) == 0
    semi = put(tmp_path / "s.csv", "id;n\n1;2\n")
    assert readers.read_table(spark, semi, sep=";").first()["n"] == 2
    lines = put(tmp_path / "a.jsonl", '{"id": 1, "t": "2024-01-01"}\n\n{"id": 2, "t": "x"}\n')
    assert readers.read_table(spark, lines).where("id is not null").dtypes == [("id", "bigint"), ("t", "string")]
    assert readers.row_count(spark, lines) == 3
    assert readers.read_json_lines(spark, lines, "id long, t string").count() == 2
    with pytest.raises(readers.FormatError, match=":2:"):
        readers.read_json_lines(spark, put(tmp_path / "b.jsonl", '{"id": 1}\nnope\n'), "id long")
    with pytest.raises(readers.FormatError):
        readers.read_table(spark, "x.txt")


def test_metrics(spark, tmp_path):
    found = readers.metric_rows(spark, put(tmp_path / "m.json", '{"train": {"acc": 0.5}, "ok": true, "name": "x", "n": 3}'))
    assert {(r["key"], r["value"], r["type"]) for r in found.collect()} == {("train.acc", "0.5", "float"), ("ok", "true", "bool"), ("name", "x", "str"), ("n", "3", "int")}
    csv = readers.metric_rows(spark, put(tmp_path / "m.csv", "acc,0.9\nepochs,10\nshort\nacc,0.95\nconverged,true\n"))
    assert {(r["key"], r["value"], r["type"]) for r in csv.collect()} == {("acc", "0.95", "float"), ("epochs", "10", "int"), ("converged", "true", "bool")}
    with pytest.raises(readers.FormatError):
        readers.metric_rows(spark, put(tmp_path / "l.json", "[1]"))
    assert [p.rsplit("/", 1)[1] for p in readers.scan_metrics(spark, str(tmp_path))] == ["l.json", "m.csv", "m.json"]


def test_plain_yaml():
    text = "a: 1\nb:\n  c: [x, 2]\n  d: true\nlist:\n  - 1\n  - two\n# no\ne: 'q: r'\n"
    expected = {"a": 1, "b": {"c": ["x", 2], "d": True}, "list": [1, "two"], "e": "q: r"}
    assert readers._plain_yaml(text) == expected == readers.parse_yaml(text)


def test_listing_skips_what_is_never_data(spark, tmp_path):
    for name in ("a.txt", "b.pyc", ".#c", "__pycache__/d.txt", "sub/e.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert {r["path"].rsplit("/", 1)[1] for r in readers.scan_files(spark, str(tmp_path)).collect()} == {"a.txt", "e.txt"}


def test_revisions(spark):
    refs = spark.createDataFrame([("branch", "v1", "aaaa1"), ("tag", "v1", "bbbb1"), ("tag", "v2", "cccc1"), ("commit", "", "abcd12"), ("commit", "", "abce12")], "kind string, name string, commit string")
    assert [readers.resolve_revision(refs, n) for n in ("v1", "v2", "abcd", "abc", "ab12", "nope")] == ["aaaa1", "cccc1", "abcd12", None, None, None]


def test_parameter_files():
    assert readers.scalar_variables([{"a": 1, "b": True, "c": [1]}, {"a": "x", "d": None}]) == {"a": "x", "b": "true"}
    assert readers.parameter_overrides({"s": {"lr": 1}, "t": 3}) == {"s": {"lr": 1}}


def test_foreign_definitions():
    stages, notes = readers.convert_foreign({"stages": {"p": {"cmd": "x", "wdir": "w", "deps": ["a", "/b"], "outs": ["c", {"d": {"cache": False}}]}, "f": {"foreach": {"u": 1, "v": 2}, "do": {"cmd": "y"}}}})
    assert stages[0]["deps"] == ["w/a", "/b"] and [o["cached"] for o in stages[0]["outs"]] == [True, False]
    assert stages[1]["items"] == ["u", "v"] and len(notes) == 1
    assert readers.export_foreign(stages)["stages"]["p"]["outs"] == ["w/c", {"w/d": {"cache": False}}]


def test_outputs_are_checked_before_any_is_written(spark, tmp_path):
    df = spark.range(2)
    with pytest.raises(KeyError):
        writers.save_outputs({"a": df}, {"a": str(tmp_path / "a.csv"), "b": "x"})
    assert not (tmp_path / "a.csv").exists()
    assert writers.save_outputs({"a": df, "more": df}, {"a": str(tmp_path / "a.csv")}) == ["more"]
    assert writers.checked_keys(["a.csv", "b/c.json"]) == ["a.csv", "b/c.json"]
    for bad in ([], ["/a.csv"], ["../a.csv"], ["a"], ["a.csv", "A.csv"]):
        with pytest.raises(readers.FormatError):
            writers.checked_keys(bad)


def test_streams(spark, tmp_path):
    folder, kind = tmp_path / "in", "ts timestamp, stage string, type string, state string, path string"
    folder.mkdir()
    rows = [("2024-01-01 00:00:0%d" % i, "s", t, s, p) for i, (t, s, p) in enumerate([("started", "a", "x.py"), ("changed", "a", "y.csv"), ("changed", "b", "y.csv"), ("completed", "b", "z.csv"), ("changed", "b", "z.csv")])]
    put(folder / "e.json", "\n".join(json.dumps(dict(zip(("ts", "stage", "type", "state", "path"), r, strict=True))) for r in rows))

    def run(df, name, mode="append"):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    changes = streams.file_changes(spark, str(folder), kind)
    assert [(r["state"], r["previous_state"]) for r in run(streams.state_changes(changes), "states")] == [("a", None), ("b", "a")]
    assert sorted(r["n_changes"] for r in run(streams.deferred_changes(changes), "deferred")) == [1, 2]
    assert sum(r["n_events"] for r in run(streams.throughput(changes, "5 seconds", "5 seconds"), "through", "complete")) == 5
    assert sorted(len(r["paths"]) for r in run(streams.change_batches(changes, "10 seconds"), "batches", "complete")) == [1, 2]
    out = tmp_path / "sink"
    for query in streams.fan_out(changes, {"json": streams.json_sink(str(out))}, str(tmp_path / "cp")).values():
        query.awaitTermination(120)
    assert spark.read.json(str(out)).count() == 5


def test_objects_are_copied_once_with_a_row_each(spark, tmp_path):
    local, remote = tmp_path / "local", tmp_path / "remote"
    names = ["0123456789abcde%x" % k for k in range(4)]
    for name in names[:3]:
        (local / name[:2]).mkdir(parents=True, exist_ok=True)
        (local / name[:2] / name[2:]).write_text(name)
    (remote / "zz").mkdir(parents=True)
    (remote / "zz" / "not-a-hash").write_text("x")
    assert {r["hash"] for r in transfer.list_objects(spark, str(local)).collect()} == set(names[:3])
    first = transfer.push(spark, str(local), str(remote)).collect()
    assert sorted((r["hash"], r["success"]) for r in first) == [(n, True) for n in names[:3]]
    assert transfer.push(spark, str(local), str(remote)).isEmpty()
    wanted = spark.createDataFrame([(n,) for n in names], "hash string")
    pulled = transfer.copy_objects(wanted, str(remote), str(tmp_path / "new")).cache()
    assert transfer.transfer_summary(pulled).first().asDict() == {"n_copied": 3, "n_failed": 1}
    assert (tmp_path / "new" / names[0][:2] / names[0][2:]).read_text() == names[0]


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    writers.save_table(spark.createDataFrame([(1,)], "id long"), path)
    with pytest.raises(Exception):
        writers.save_table(spark.createDataFrame([("x",)], "id string").selectExpr("cast(id as int) as id"), path)
    writers.save_table(spark.createDataFrame([(2,), (3,)], "id long"), str(tmp_path / "u.jsonl"))
    assert readers.read_table(spark, path).collect()[0]["id"] == 1 and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["t.csv", "u.jsonl"]
    writers.save_table(spark.createDataFrame([(5,)], "id long"), path)
    assert [r["id"] for r in readers.read_table(spark, path).collect()] == [5]
