import pytest
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators import cache, expand, graph, history, incremental, patterns, staleness
from weftline.operators.runtime import Output, Pipeline, RegistryError, Stage, code_hash, fingerprint
from weftline.plans import closure
from weftline.plans.closure import longest_levels, reachable, reachable_after, reached
from weftline.schemas import empty, parse_locks
from weftline.streaming import events as E


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def stages(spark, spec):
    data = [(n, deps, [(o, "data", True, False) for o in outs]) for n, (deps, outs) in spec.items()]
    return spark.createDataFrame(data, "name string, deps array<string>, outs array<struct<path: string, kind: string, cached: boolean, incremental: boolean>>")


DIAMOND = {"a": ([], ["x"]), "b": (["x"], ["y"]), "c": (["x"], ["z"]), "d": (["y", "z"], ["w"])}


def test_graph_of_a_diamond(spark):
    edges = graph.build_edges(stages(spark, DIAMOND))
    assert rows(graph.stage_edges(edges), "src", "dst") == [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]
    assert rows(graph.artifact_edges(edges), "src", "dst") == [("x", "y"), ("x", "z"), ("y", "w"), ("z", "w")]
    assert rows(graph.downstream(edges).where("src = 'a'"), "dst") == [("a", "b"), ("a", "c"), ("a", "d")]
    assert rows(graph.upstream_once(edges, "d"), "stage") == [("b",), ("c",)]
    assert rows(graph.consumers(edges, "x"), "stage") == [("b",), ("c",)]
    assert rows(graph.producer(edges, "x"), "stage") == [("a",)]
    placed = graph.levels(stages(spark, DIAMOND).select(F.col("name").alias("stage")), edges)
    assert rows(placed, "stage") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert graph.cycles(edges).isEmpty()
    assert rows(graph.upstream_closure(edges, spark.createDataFrame([("b",)], "stage string")), "stage") == [("a",), ("b",)]
    assert graph.topological_text(edges).first()["text"].startswith("flowchart TD\n    a --> b")


def test_folder_dependencies(spark):
    edges = graph.build_edges(stages(spark, {"a": ([], ["data/in/x.csv"]), "b": ([], ["data/in/y.csv"]), "c": (["data/in"], ["out/"]), "d": (["out/part.csv"], [])}))
    assert rows(graph.stage_edges(edges), "src", "dst") == [("a", "c"), ("b", "c"), ("c", "d")]


def test_a_graph_whose_inputs_are_all_outputs_is_built_without_joins(spark):
    plan = graph.build_edges(stages(spark, DIAMOND))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_paths_of_one_folder_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "A_TASK", 10)
    spec = {f"s{n:02}": ([], [f"data/{n:02}.csv", f"data/{n:02}.txt"]) for n in range(50)} | {"all": (["data/"], ["done/"]), "one": (["data/03.csv"], [])} | {f"t{n}": ([f"done/{n}"], []) for n in range(30)}
    table = stages(spark, spec)
    edges = graph.build_edges(table)
    found = graph.producers_of(graph.stage_deps(table), graph.stage_outs(table))
    every = [("all", "data/", f"s{n:02}", f"data/{n:02}.csv") for n in range(50)] + [("one", "data/03.csv", "s03", "data/03.csv")] + [(f"t{n}", f"done/{n}", "all", "done/") for n in range(30)]
    assert rows(found, "stage", "producer") == sorted(every)
    assert rows(graph.stage_edges(edges), "src", "dst") == sorted({(p, s) for s, _, p, _ in every})
    assert edges.count() == edges.distinct().count() == 101 + 32 + 80  # made, own and linked
    paths = graph.stage_outs(table).select("path", F.explode(S.ancestors(F.col("path"))).alias("at"))
    joined = graph._join_dealt(paths, spark.createDataFrame([("data",)], "at string"), "at")
    assert joined.count() == 100
    cells = [r["count"] for r in joined.groupBy("cell").count().collect()]
    assert len(cells) == 10 and max(cells) < 30


def test_a_cycle_is_named(spark):
    spec = {"in": ([], ["x"]), "a": (["x", "r"], ["p"]), "b": (["p"], ["q"]), "c": (["q"], ["r"]), "d": (["p", "r"], ["s"]), "out": (["s"], ["t"])}
    edges = graph.build_edges(stages(spark, spec))
    assert rows(graph.cycles(edges), "stage") == [("a",), ("b",), ("c",)]
    assert graph.cycle_path(edges) == ["a", "b", "c", "a"]
    assert graph.cycle_path(graph.build_edges(stages(spark, DIAMOND))) == []


def test_changes_within_runs_wait(spark):
    runs = spark.createDataFrame([("u", 10, 20), ("u", 15, 40), ("u", 50, 60), (None, 1, 99)], "key string, start_ts long, end_ts long")
    changes = spark.createDataFrame([(1, "u", 10), (2, "u", 20), (3, "u", 40), (4, "u", 55), (5, "v", 55), (6, None, 5), (7, "u", 9)], "event_id int, key string, ts long")
    found = E.deferred(changes, runs, "key").select("event_id", "effective_ts", "deferred")
    assert rows(found, "event_id") == [(1, 20, True), (2, 40, True), (3, 40, False), (4, 60, True), (5, 55, False), (6, 5, False), (7, 9, False)]


def test_cycles_end(spark):
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    assert rows(reachable(loop).where("src = dst").select("src"), "src") == [("a",), ("b",)]
    with pytest.raises(ValueError):
        longest_levels(spark.createDataFrame([("a",), ("b",), ("c",)], "node string"), loop)


def chain(spark, length):
    return spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(length)], "src string, dst string")


def test_the_plan_of_levels_does_not_grow_with_the_graph(spark):
    def joins(length):
        found = longest_levels(chain(spark, length).select(F.col("src").alias("node")), chain(spark, length))
        assert [r["level"] for r in found.orderBy("level").collect()] == list(range(length))
        return found._jdf.queryExecution().optimizedPlan().toString().count("Join")

    assert joins(2) == joins(7)


def test_pairs_are_not_held_against_those_known_where_there_are_no_cycles(spark):
    found = reachable(chain(spark, 5))
    assert '"array"' in found._jdf.queryExecution().optimizedPlan().collectLeaves().apply(0).schema().json()
    assert found.count() == 15


@pytest.mark.parametrize("loop", [(), (("n6", "n1"),)])
@pytest.mark.parametrize("sizes", [(65_536, 1024, 4_000_000), (3, 2, 5)])
def test_pairs_and_nodes_equal_a_plain_search(spark, monkeypatch, loop, sizes):
    for name, size in zip(("ARRAY", "FAN", "A_TASK"), sizes):
        monkeypatch.setattr(closure, name, size)
    edges = sorted({(f"n{d // k}", f"n{d}") for d in range(2, 24) for k in (2, 3) if d >= k} | set(loop))

    def after(node):
        seen, todo = set(), [node]
        while todo:
            here = todo.pop()
            new = {d for s, d in edges if s == here} - seen
            seen, todo = seen | new, todo + list(new)
        return seen

    df, starts = spark.createDataFrame(edges, "src string, dst string"), [("p", "n3"), ("p", "n5"), ("q", "z")]
    seeds = spark.createDataFrame([("n2",), ("n5",), ("z",)], "src string")
    assert rows(reachable(df), "src", "dst") == sorted((s, d) for s in {e[0] for e in edges} for d in after(s))
    assert rows(reachable(df, seeds), "src", "dst") == sorted((s, d) for s in ("n2", "n5") for d in after(s))
    assert rows(reached(df, seeds), "dst") == sorted((d,) for d in after("n2") | after("n5"))
    assert rows(reachable_after(spark.createDataFrame(starts, "src string, dst string"), df), "src", "dst") == sorted(set(starts) | {(p, d) for p, s in starts for d in after(s)})


def test_edge_changes_keep_copies_and_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(graph, "A_TASK", 2)
    kind = "src string, src_type string, dst string, dst_type string"
    a, b, c, d = [(x, "stage", x + ".csv", "artifact") for x in "abcd"]
    found = graph.edge_changes(spark.createDataFrame([a, a, a, b, c], kind), spark.createDataFrame([a, b, d, d], kind))
    assert rows(found, "src", "change_type") == [(*a, "removed"), (*a, "removed"), (*c, "removed"), (*d, "added"), (*d, "added")]
    assert found.rdd.getNumPartitions() == 5


def test_overlaps(spark):
    outs = spark.createDataFrame([("a", "x/y"), ("b", "x/y"), ("c", "x/"), ("d", "x2")], "stage string, path string")
    assert rows(graph.output_overlaps(outs), "kind", "stage_a", "stage_b") == [("a", "x/y", "b", "x/y", "duplicate"), ("c", "x/", "a", "x/y", "parent"), ("c", "x/", "b", "x/y", "parent")]


def test_external_pipelines(spark):
    own = stages(spark, {"d": (["lib/m/x.csv"], ["out"])})
    others = stages(spark, {"m": (["lib/raw.csv"], ["lib/m/x.csv"]), "r": ([], ["lib/raw.csv"]), "n": ([], ["else"])})
    outputs = spark.createDataFrame([("lib/m/x.csv", "m", "lib", 3), ("lib/raw.csv", "r", "lib", 3), ("else", "n", "z", 3)], "path string, stage string, pipeline string, tier int")
    assert rows(graph.resolve_external(own, others, outputs).select("name"), "name") == [("d",), ("m",), ("r",)]
    own = spark.createDataFrame([("a",), ("p/t",), ("p/t_2",), ("p/t_4",), ("p/b",), ("t",)], "name string")
    assert rows(graph.include_pipeline(own, spark.createDataFrame([("t",), ("b",), ("c",)], "name string"), "p"), "name") == [("b", "p/b_2"), ("c", "p/c"), ("t", "p/t_3")]
    renamed = graph.include_pipeline(spark.createDataFrame([("a",)], "name string"), spark.createDataFrame([("a",), ("b",)], "name string"), "sub")
    assert rows(renamed, "name") == [("a", "sub/a"), ("b", "sub/b")]


def test_scalars(spark):
    df = spark.createDataFrame([("true",), ("-3",), ("1_0",), ("2.5e3",), ("t",), (None,), (" 7 ",)], "v string")
    assert [r[0] for r in df.select(S.value_type(F.col("v"))).collect()] == ["bool", "int", "int", "float", "str", None, "int"]
    assert [r[0] for r in df.select(S.parsed_number(F.col("v"))).collect()] == [1.0, -3.0, 10.0, 2500.0, None, None, 7.0]
    paths = spark.createDataFrame([("/a/./b//c/../d/",), ("../x",), ("/../x",), ("",), ("a/b/../../..",)], "p string")
    assert [r[0] for r in paths.select(S.canonical_path(F.col("p"))).collect()] == ["/a/b/d/", "../x", "/x", ".", ".."]
    ms = spark.createDataFrame([(9,), (43150,), (1250,), (61000,), (150500,)], "m long")
    assert [r[0] for r in ms.select(S.elapsed(F.col("m"))).collect()] == ["9ms", "43.1s", "1.2s", "1m1s", "2m30s"]
    assert [f"{m / 1000:.1f}s" for m in (43150, 1250)] == ["43.1s", "1.2s"]


def test_every_shown_second_is_rounded_as_python_does(spark):
    df = spark.range(1000, 60000).select("id", S.elapsed(F.col("id")).alias("s"))
    assert [r["id"] for r in df.collect() if r["s"] != f"{r['id'] / 1000:.1f}s"] == []


def test_ignore_patterns(spark):
    found = patterns.parse_ignore([("p", "*.log"), ("p", "!keep.log"), ("p", "/build/"), ("p", "a/**/z"), ("p", ""), ("p", "# no")], spark)
    paths = spark.createDataFrame([(p,) for p in ("x.log", "d/x.log", "keep.log", "build/x", "src/build/x", "a/z", "a/b/c/z", "y")], "path string")
    ignored = {r["path"] for r in patterns.check_ignored(paths, found).where("ignored").collect()}
    assert ignored == {"x.log", "d/x.log", "build/x", "a/z", "a/b/c/z"}


def test_staleness_reaches_all_below(spark):
    own = spark.createDataFrame([("a", True), ("b", False), ("c", False), ("d", False), ("e", False)], "stage string, stale boolean")
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "src string, dst string")
    assert rows(staleness.propagate_stale(own, links), "stage") == [("a", True, True, ""), ("b", True, False, "a"), ("c", True, False, "a"), ("d", True, False, "b,c"), ("e", False, False, "")]


def test_damaged_locks_count_as_missing(spark):
    text = spark.createDataFrame([('{"stage":"a","code_manifest":{},"params":"{}","deps":[],"outs":[],"extra":1}',), ('{"stage":"b"}',), ("no",)], "text string")
    assert [r["stage"] for r in parse_locks(text).collect()] == ["a"]
    assert empty(spark, "runs").count() == 0


def test_objects(spark):
    files = spark.createDataFrame([("a", b"x", 1, 1, 1), ("b", b"x", 1, 1, 2), ("c", None, 1, 1, 3)], "path string, content binary, size long, mtime_ns long, inode long")
    hashed = {r["path"]: r["hash"] for r in cache.with_content_hash(files).collect()}
    assert hashed["a"] == hashed["b"] and hashed["c"] is None
    known = spark.createDataFrame([("a", 1, 1, 1, "old"), ("b", 1, 9, 2, "old")], "path string, size long, mtime_ns long, inode long, hash string")
    assert {r["path"]: r["hash"] for r in cache.with_content_hash(files, known).collect()}["a"] == "old"
    assert {r["path"]: r["hash"] for r in cache.with_content_hash(files, known).collect()}["b"] == hashed["b"]


def test_generation_skip_without_inputs_or_records(spark):
    own = spark.createDataFrame([("a", True), ("b", True)], "stage string, same boolean")
    deps = spark.createDataFrame([("b", "x")], "stage string, path string")
    none = spark.createDataFrame([], "stage string, path string, gen long")
    current = spark.createDataFrame([("x", 1)], "path string, gen long")
    assert rows(incremental.generation_skip(own, deps, none, current), "stage") == [("a", True), ("b", False)]


def test_deferred_writes(spark):
    done = spark.createDataFrame([("a", "h", "r1")], "stage string, input_hash string, run_id string")
    outs = spark.createDataFrame([("a", "o1", "1", True), ("a", "o2", "2", False), ("b", "o3", "3", True)], "stage string, path string, hash string, cached boolean")
    deps = spark.createDataFrame([("a", "d")], "stage string, path string")
    made = incremental.deferred_writes(done, outs, deps, spark.createDataFrame([("d", 4)], "path string, gen long"), "c1")
    assert rows(made["dep_generations"], "path") == [("a", "d", 4, "c1")]
    assert [r["path"] for r in made["writes"].orderBy("path").collect()] == ["o1", "o2"]
    assert [len(r["output_hashes"]) for r in made["run_cache"].collect()] == [1]


def test_matrix(spark):
    dims = {"model": spark.createDataFrame([("bert",), ("gpt",)], "value string"), "data": spark.createDataFrame([("swe",), ("human",)], "value string")}
    assert {r["stage"] for r in expand.expand_matrix(dims, "train").collect()} == {"train@bert_swe", "train@bert_human", "train@gpt_swe", "train@gpt_human"}
    assert expand.expand_matrix(dims, "train", "{nope}") is None
    assert expand.expand_matrix({}, "train").columns == ["stage"] and expand.expand_matrix({}, "train").isEmpty()
    assert expand.split_template("train@{model}_x") == ("train", "{model}_x") and expand.split_template("train") == ("train", None)
    with pytest.raises(ValueError):
        expand.check_template("{model}", ["model", "data"])
    empty_dim = {**dims, "data": dims["data"].limit(0)}
    assert expand.expand_matrix(empty_dim, "train").isEmpty()


def test_deep_merge_hides_parts_and_wholes(spark):
    layers = spark.createDataFrame([("a.b", "1", 0), ("a.c", "2", 0), ("a", "x", 1), ("d", "y", 0), ("d.e", "z", 1)], "key string, value string, priority int")
    assert rows(expand.deep_merge(layers), "key") == [("a", "x"), ("d.e", "z")]


def test_flattening(spark):
    nested = spark.createDataFrame([('{"train": {"acc": 0.9, "sub": {"n": 1}}, "tags": [1, 2], "name": "m"}',)], "text string")
    odd = spark.createDataFrame([('{"d": "{\\"k\\": 2}", "e": "{not json", "f": {}, "g": {"h": {"i": null}}}',), ("[1]",), ("nope",), (None,)], "text string")
    assert rows(expand.flattened_json(odd), "key") == [("d", '{"k": 2}'), ("e", "{not json"), ("g.h.i", None)]
    deep = "1"
    for k in range(70):
        deep = '{"k": ' + deep + "}"
    assert rows(expand.flattened_json(spark.createDataFrame([(deep,)], "text string")), "key") == [(".".join("k" * 70), "1")]
    assert rows(expand.flattened_json(nested), "key") == [("name", "m"), ("tags", "[1,2]"), ("train.acc", "0.9"), ("train.sub.n", "1")]
    assert expand.flattened(spark.sql("select named_struct('b', 1, 'c', named_struct('d', 2)) a")).columns == ["a.b", "a.c.d"]


def test_scheduling_step(spark):
    kind = "stage string, mutex array<string>, position int"
    ready = spark.createDataFrame([("a", ["m"], 1), ("b", ["m"], 2), ("c", [], 3), ("d", ["*"], 4), ("e", ["n"], 5)], kind)
    running = spark.createDataFrame([("z", ["n"], 0)], kind)
    assert [r["stage"] for r in E.startable(ready, running, 5).collect()] == ["a", "c"]
    assert E.startable(ready, spark.createDataFrame([("z", ["*"], 0)], kind), 5).isEmpty()


def test_lines_and_buffers(spark):
    chunks = spark.createDataFrame([("s", 1, "ab"), ("s", 2, "c\nde"), ("s", 3, "f\n")], "stage string, seq int, text string")
    lines = E.split_lines(chunks, "stage", "seq")
    assert [r["line"] for r in lines.orderBy("line_no").collect()] == ["abc", "def"]
    kept = E.ring_buffer(lines.withColumn("seq", F.col("line_no")), "stage", ["seq"], 1)
    assert [(r["line"], r["n_dropped"]) for r in kept.collect()] == [("def", 1)]
    assert {r["line"] for r in E.shown_lines(kept, "stage").collect()} == {"def", "[1 earlier lines truncated]"}


def test_timings_leave_out_what_is_not_finite(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan")), ("a", float("inf")), ("b", None)], "name string, duration_ms double")
    assert rows(history.timing_summary(df), "name") == [("a", 2, 4.0, 2.0, 1.0, 3.0)]


def helper(x):
    return x + 1


def with_docs(a):
    """Says nothing."""
    # nothing
    return helper(a)


def without_docs(a):
    return helper(a)


def other(a):
    return helper(a) + 1


def test_fingerprints_ignore_what_does_not_matter():
    assert code_hash(with_docs) == code_hash(without_docs) != code_hash(other)
    assert set(fingerprint(with_docs)) == {"self", "func:helper"}


def test_pipeline_runs_in_order_and_stops_below_failures(spark):
    pipeline, store, ran = Pipeline(), {"raw": spark.range(3).toDF("n")}, []

    @pipeline.stage("clean", {"raw": "raw"}, {"out": Output("clean")})
    def clean(spark, inputs, params):
        ran.append("clean")
        return inputs["raw"].where("n > 0")

    @pipeline.stage("bad", {"x": "clean"}, {"out": Output("bad")}, mutex=("m",))
    def bad(spark, inputs, params):
        raise RuntimeError("no")

    @pipeline.stage("last", {"x": "bad"}, {"out": Output("last")})
    def last(spark, inputs, params):
        return inputs["x"]

    @pipeline.stage("side", {"x": "clean"}, {"out": Output("side")}, mutex=("m",))
    def side(spark, inputs, params):
        return inputs["x"]

    results = pipeline.run(spark, store.get, store.__setitem__, keep_going=True)
    assert {n: s for n, (s, _) in results.items()} == {"clean": "ran", "bad": "failed", "last": "blocked", "side": "ran"}
    assert store["side"].count() == 2
    assert set(pipeline.run(spark, store.get, store.__setitem__, targets=["clean"], skip=lambda s: True).values()) == {("skipped", "unchanged")}
    assert pipeline.to_table(spark).count() == 4
    with pytest.raises(RegistryError):
        pipeline.register(Stage("again", clean, {}, {"o": Output("clean/part")}))
    with pytest.raises(RegistryError):
        pipeline.register(Stage("inc", clean, {}, {"o": Output("state", incremental=True)}))
