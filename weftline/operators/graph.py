"""The bipartite graph of artifacts and stages: building, neighbours, closures, levels, views and checks.

Edges run artifact -> stage (consumed) and stage -> artifact (produced). Path relations
(equal, inside, around) are equi-joins over exploded ancestors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.scalars import ancestors, stage_base, stage_variant
from weftline.plans.closure import cyclic_part, longest_levels, reachable, reachable_after, reached
from weftline.plans.scratch import materialize, release

ARTIFACT, STAGE = "artifact", "stage"
#: Edges that one task compares; paths of one folder that one task joins.
A_TASK = 500_000


def stage_deps(stages: DataFrame) -> DataFrame:
    """(stage, path) of every dependency."""
    return stages.select(F.col("name").alias("stage"), F.explode("deps").alias("path"))


def stage_outs(stages: DataFrame) -> DataFrame:
    """(stage, path, kind, cached, incremental) of every output."""
    return stages.select(F.col("name").alias("stage"), F.explode("outs").alias("o")).select("stage", "o.*")


def _dep_paths(deps: DataFrame) -> DataFrame:
    return materialize(deps.select("stage", F.col("path").alias("dep")).distinct(), "graph-deps")


def _out_paths(outs: DataFrame) -> DataFrame:
    return materialize(outs.select(F.col("stage").alias("producer"), F.col("path").alias("artifact")).distinct(), "graph-outs")


def producers_of(deps: DataFrame, outs: DataFrame) -> DataFrame:
    """(stage, dep, producer, artifact): who makes each dependency.

    The output of the same path; without one, each stage's first output below the path and
    the shortest output around it.
    """
    d, o = _dep_paths(deps), _out_paths(outs)
    exact = d.join(o, d.dep == o.artifact).select("stage", "dep", "producer", "artifact")
    by_folder = _producers_by_folder(d, o)
    return exact if by_folder is None else exact.union(by_folder)


def _producers_by_folder(d: DataFrame, o: DataFrame) -> DataFrame | None:
    """(stage, dep, producer, artifact) of the dependencies that are no output themselves; None if all are."""
    rest = materialize(d.join(o.select(F.col("artifact").alias("dep")).distinct(), "dep", "left_anti"), "graph-rest")
    if rest.isEmpty():
        release(rest)
        return None
    dep, artifact = (F.rtrim(F.col(c), F.lit("/")) for c in ("dep", "artifact"))
    below = _join_dealt(o.withColumn("at", F.explode(ancestors(artifact))), rest.withColumn("at", dep), "at")
    first_below = below.groupBy("stage", "dep", "producer").agg(F.min("artifact").alias("artifact"))
    around = _join_dealt(rest.withColumn("at", F.explode(ancestors(dep))), o.withColumn("at", artifact), "at")
    shortest = around.groupBy("stage", "dep").agg(F.min_by(F.struct("producer", "artifact"), F.struct(F.length("artifact"), "producer")).alias("best")).select("stage", "dep", "best.producer", "best.artifact")
    return first_below.union(shortest)


def _join_dealt(many: DataFrame, few: DataFrame, on: str) -> DataFrame:
    """The join on a column of which ``many`` can have one value very often: its rows are dealt to cells of about A_TASK, and the rows of ``few`` go to each."""
    often = F.broadcast(many.groupBy(on).agg(F.ceil(F.count(F.lit(1)) / A_TASK).alias("cells")).where("cells > 1"))  # no more rows than many has A_TASK
    cells = F.coalesce("cells", F.lit(1).cast("bigint"))
    dealt = many.join(often, on, "left").withColumn("cell", F.pmod(F.xxhash64(*[c for c in many.columns if c != on]), cells)).drop("cells")
    copied = few.join(often, on, "left").withColumn("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), cells - 1))).drop("cells")
    return dealt.join(copied, [on, "cell"])


def build_edges(stages: DataFrame) -> DataFrame:
    """Typed edges of the graph of a stages table; a dependency that is an output itself is linked to its stage by its own edge."""
    d, o = _dep_paths(stage_deps(stages)), _out_paths(stage_outs(stages))
    made = o.select(F.col("producer").alias("src"), F.lit(STAGE).alias("src_type"), F.col("artifact").alias("dst"), F.lit(ARTIFACT).alias("dst_type"))
    used = lambda table, path: table.select(F.col(path).alias("src"), F.lit(ARTIFACT).alias("src_type"), F.col("stage").alias("dst"), F.lit(STAGE).alias("dst_type"))
    own, by_folder = used(d, "dep"), _producers_by_folder(d, o)
    return made.union(own if by_folder is None else own.union(used(by_folder, "artifact")).distinct())


def unresolved_deps(stages: DataFrame, existing: DataFrame) -> DataFrame:
    """(stage, path) of dependencies that no stage makes and that aren't there or tracked."""
    deps = stage_deps(stages)
    made = producers_of(deps, stage_outs(stages)).select("stage", F.col("dep").alias("path")).distinct()
    return deps.join(made, ["stage", "path"], "left_anti").join(covered_paths(deps, existing), "path", "left_anti")


def covered_paths(paths: DataFrame, tracked: DataFrame) -> DataFrame:
    """Distinct paths that are tracked, inside of a tracked path, or hold one."""
    p = paths.select("path").distinct().withColumn("at", F.rtrim(F.col("path"), F.lit("/")))
    t = tracked.select(F.rtrim(F.col("path"), F.lit("/")).alias("at")).distinct()
    exact = p.join(t, "at", "left_semi").select("path")
    inside = p.select("path", F.explode(ancestors(F.col("at"))).alias("at")).join(t, "at", "left_semi").select("path")
    holds = p.join(t.select(F.explode(ancestors(F.col("at"))).alias("at")).distinct(), "at", "left_semi").select("path")
    return exact.union(inside).union(holds).distinct()


def output_overlaps(outs: DataFrame) -> DataFrame:
    """(stage_a, path_a, stage_b, path_b, kind) of outputs that are equal (duplicate) or of which a holds b (parent)."""
    o = outs.select("stage", "path").withColumn("at", F.rtrim(F.col("path"), F.lit("/")))
    a = o.select(F.col("stage").alias("stage_a"), F.col("path").alias("path_a"), "at")
    b = o.select(F.col("stage").alias("stage_b"), F.col("path").alias("path_b"), "at")
    same = a.join(b, "at").where("stage_a < stage_b").withColumn("kind", F.lit("duplicate"))
    inside = a.join(b.select("stage_b", "path_b", F.explode(ancestors(F.col("at"))).alias("at")), "at").withColumn("kind", F.lit("parent"))
    return same.union(inside.select(same.columns)).select("stage_a", "path_a", "stage_b", "path_b", "kind")


def consumers(edges: DataFrame, path: str) -> DataFrame:
    return edges.where((F.col("src") == path) & (F.col("src_type") == ARTIFACT)).select(F.col("dst").alias("stage"))


def producer(edges: DataFrame, path: str) -> DataFrame:
    return edges.where((F.col("dst") == path) & (F.col("dst_type") == ARTIFACT)).select(F.col("src").alias("stage"))


def stage_edges(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst): dst consumes what src makes."""
    made = edges.where(F.col("dst_type") == ARTIFACT).select("src", F.col("dst").alias("via"))
    used = edges.where(F.col("src_type") == ARTIFACT).select(F.col("src").alias("via"), "dst")
    return made.join(used, "via").where("src <> dst").select("src", "dst").distinct()


def artifact_edges(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst): a stage consumes src and makes dst."""
    used = edges.where(F.col("src_type") == ARTIFACT).select("src", F.col("dst").alias("via"))
    made = edges.where(F.col("dst_type") == ARTIFACT).select(F.col("src").alias("via"), "dst")
    return used.join(made, "via").select("src", "dst").distinct()


def stage_dag(edges: DataFrame) -> DataFrame:
    """Stage edges from consumer to producer."""
    return stage_edges(edges).select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def downstream(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(src, dst) of all stages that depend on src, directly or not; of the seeds (column ``src``) if given."""
    return reachable(stage_edges(edges), seeds)


def upstream_once(edges: DataFrame, stage: str) -> DataFrame:
    """Makers of a stage's inputs, one row an input, so a maker of two comes twice."""
    used = edges.where((F.col("dst") == stage) & (F.col("src_type") == ARTIFACT)).select(F.col("src").alias("via"))
    return edges.where(F.col("dst_type") == ARTIFACT).join(used, edges.dst == used.via).select(F.col("src").alias("stage"))


def upstream_closure(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """The targets (column ``stage``) and all that they depend on."""
    back = reached(stage_dag(edges), targets.select(F.col("stage").alias("src")))
    return targets.select("stage").union(back.select(F.col("dst").alias("stage"))).distinct()


def affected_stages(edges: DataFrame, paths: DataFrame, include_downstream: bool = True) -> DataFrame:
    """(path, stage): consumers of each path and, if wanted, all that depends on them."""
    if include_downstream:
        edges = materialize(edges, "edges")
    direct = paths.select("path").distinct().join(edges.where(F.col("src_type") == ARTIFACT).select(F.col("src").alias("path"), F.col("dst").alias("stage")), "path")
    if not include_downstream:
        return direct.distinct()
    return reachable_after(direct.select(F.col("path").alias("src"), F.col("stage").alias("dst")), stage_edges(edges)).select(F.col("src").alias("path"), F.col("dst").alias("stage"))


def touched_stages(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Distinct stages that consume one of the paths or depend on one that does, without the pairs."""
    edges = materialize(edges, "edges")
    direct = materialize(affected_stages(edges, paths, include_downstream=False).select("stage").distinct(), "direct")
    return direct.union(reached(stage_edges(edges), direct.select(F.col("stage").alias("src"))).select(F.col("dst").alias("stage"))).distinct()


def levels(stages: DataFrame, edges: DataFrame) -> DataFrame:
    """(stage, level): 0 for stages without makers, else one more than their highest."""
    return longest_levels(stages.select(F.col("stage").alias("node")), stage_edges(edges)).select(F.col("node").alias("stage"), "level")


def execution_order(stages: DataFrame, edges: DataFrame) -> DataFrame:
    """(stage, level, position): any order in which makers come first is right; this one is by level, then name."""
    from weftline.operators.diff import with_position

    return with_position(levels(stages, edges), ["level", "stage"])


def cycles(edges: DataFrame) -> DataFrame:
    """Stages that depend on themselves; only what is left of the graph without its ends is closed."""
    return reachable(cyclic_part(stage_edges(edges))).where("src = dst").select(F.col("src").alias("stage"))


def cycle_path(edges: DataFrame) -> list[str]:
    """The stages of a shortest cycle through the first stage that is on one, which comes first and last; empty without one.

    Goes on from that stage in rounds; the driver gets one stage a step of the cycle.
    """
    left = cyclic_part(stage_edges(edges))
    start = reachable(left).where("src = dst").agg(F.min("src")).first()[0]
    if start is None:
        return []
    steps, seen = [], None
    frontier = left.where(F.col("src") == start).select(F.lit(start).alias("before"), F.col("dst").alias("stage"))
    while True:
        step = materialize(frontier.groupBy("stage").agg(F.min("before").alias("before")), "cycle-step")
        steps.append(step)
        if not step.where(F.col("stage") == start).isEmpty():
            break
        seen = step.select("stage") if seen is None else seen.union(step.select("stage"))
        ahead = step.select(F.col("stage").alias("src")).join(left, "src").select(F.col("src").alias("before"), F.col("dst").alias("stage"))
        frontier = ahead.join(seen, "stage", "left_anti")
    path = [start]
    for step in reversed(steps):
        path.append(step.where(F.col("stage") == path[-1]).first()["before"])
    return path[::-1]


def display_order(placed: DataFrame) -> DataFrame:
    """(stage, level, base, variant, base_level): sorted by the lowest level of the base name, base, level, variant."""
    named = placed.withColumn("base", stage_base(F.col("stage"))).withColumn("variant", stage_variant(F.col("stage")))
    low = named.groupBy("base").agg(F.min("level").alias("base_level"))
    return named.join(low, "base").select("stage", "level", "base", "variant", "base_level").orderBy("base_level", "base", "level", "variant")


def edge_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges added and removed when a stage changes."""
    sides = old.withColumn("n", F.lit(1)).union(new.withColumn("n", F.lit(-1)))
    marked = materialize(sides, "edge-sides")
    spread = marked.repartition(max(1, -(-marked.count() // A_TASK)), *old.columns)
    kind = F.when(F.col("n") > 0, "removed").otherwise("added").alias("change_type")
    net = spread.groupBy(*old.columns).agg(F.sum("n").alias("n")).where("n <> 0")
    return net.select(*old.columns, kind, F.explode(F.array_repeat(F.lit(1), F.abs("n").cast("int")))).drop("col")


def orphan_artifacts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Artifacts of the old edges that no new edge touches."""

    def artifacts(edges: DataFrame) -> DataFrame:
        return edges.where(F.col("src_type") == ARTIFACT).select(F.col("src").alias("path")).union(edges.where(F.col("dst_type") == ARTIFACT).select(F.col("dst").alias("path"))).distinct()

    return artifacts(old).join(artifacts(new), "path", "left_anti")


def watch_paths(edges: DataFrame) -> DataFrame:
    """All artifacts, to be watched."""
    return edges.where(F.col("src_type") == ARTIFACT).select(F.col("src").alias("path")).union(edges.where(F.col("dst_type") == ARTIFACT).select(F.col("dst").alias("path"))).distinct()


def upstream_subgraph(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges among the targets, what they depend on, and their outputs."""
    kept = upstream_closure(edges, targets)
    used = edges.where(F.col("dst_type") == STAGE).join(kept, edges.dst == kept.stage, "left_semi")
    made = edges.where(F.col("src_type") == STAGE).join(kept, edges.src == kept.stage, "left_semi")
    return used.union(made)


def resolve_targets(targets: DataFrame, stages: DataFrame, edges: DataFrame) -> DataFrame:
    """(target, stage): the stage of that name, else the maker of that path; null for neither."""
    named = targets.join(stages.select(F.col("stage").alias("target"), F.col("stage").alias("by_name")), "target", "left")
    made = edges.where(F.col("dst_type") == ARTIFACT).select(F.col("dst").alias("target"), F.col("src").alias("by_path"))
    return named.join(made, "target", "left").select("target", F.coalesce("by_name", "by_path").alias("stage"))


def nearest_config(paths: DataFrame, configs: DataFrame, include_own: bool = True) -> DataFrame:
    """(path, config_dir, distance) of the definitions in the folders around a path, nearest first."""
    around = paths.select("path", F.explode(ancestors(F.col("path"))).alias("config_dir"))
    found = around.join(configs.select("config_dir"), "config_dir").withColumn("distance", F.size(F.split("path", "/")) - F.size(F.split("config_dir", "/")))
    return (found if include_own else found.where("distance > 1")).select("path", "config_dir", "distance")


def external_producers(missing: DataFrame, outputs: DataFrame) -> DataFrame:
    """(path, stage, pipeline, tier): the maker of a dependency in another pipeline.

    ``outputs`` has path, stage, pipeline (its folder) and tier. Pipelines around the path
    come first, nearest first (tier 1), then the index (2), then all (3).
    """
    found = missing.select("path").distinct().join(outputs, "path")
    inside = F.col("path").startswith(F.concat(F.rtrim(F.col("pipeline"), F.lit("/")), F.lit("/")))
    tier = F.when(inside, 1).otherwise(F.greatest(F.col("tier"), F.lit(2))).alias("tier")
    ranked = found.select("path", "stage", "pipeline", tier, F.length("pipeline").alias("depth"))
    best = ranked.groupBy("path").agg(F.min_by(F.struct("stage", "pipeline", "tier"), F.struct("tier", -F.col("depth"), "pipeline", "stage")).alias("b"))
    return best.select("path", "b.*")


def resolve_external(stages: DataFrame, others: DataFrame, outputs: DataFrame) -> DataFrame:
    """The stages with those of other pipelines that they need, in rounds until nothing is missing that anyone makes."""
    known = stages
    while True:
        missing = stage_deps(known).join(stage_outs(known).select("path").distinct(), "path", "left_anti").select("path").distinct()
        need = external_producers(missing, outputs).select(F.col("stage").alias("name")).distinct().join(known.select("name"), "name", "left_anti")
        added = materialize(others.join(need, "name", "left_semi"), "resolved")
        if added.isEmpty():
            return known
        known = known.unionByName(added)


def include_pipeline(own: DataFrame, incoming: DataFrame, prefix: str) -> DataFrame:
    """(name, new_name) of the incoming stages: prefixed if any name is taken, and numbered from 2 by the first free number where that is taken too."""
    taken = not incoming.join(own, "name", "left_semi").isEmpty()
    if not taken:
        return incoming.select("name", F.col("name").alias("new_name"))
    renamed = incoming.select("name", F.concat(F.lit(prefix + "/"), "name").alias("base"))
    clash = own.select(F.col("name").alias("base")).distinct().withColumn("clash", F.lit(True))
    numbered = own.select(F.regexp_extract("name", r"^(.*)_([1-9][0-9]{0,8})$", 1).alias("base"), F.regexp_extract("name", r"^(.*)_([1-9][0-9]{0,8})$", 2).alias("n"))
    used = numbered.where("n <> ''").groupBy("base").agg(F.collect_set(F.col("n").cast("int")).alias("used"))
    free = F.get(F.filter(F.sequence(F.lit(2), F.size("used") + 2), lambda n: ~F.array_contains("used", n)), 0)
    named = renamed.join(clash, "base", "left").join(used, "base", "left").withColumn("used", F.coalesce("used", F.array().cast("array<int>")))
    return named.select("name", F.when(F.col("clash"), F.concat("base", F.lit("_"), free.cast("string"))).otherwise(F.col("base")).alias("new_name"))


def output_sources(outs: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """(path, stage) of every output; the last stage registered wins."""
    return outs.groupBy("path").agg(F.max_by("stage", ordinal).alias("stage"))


def topological_text(edges: DataFrame, kind: str = "mermaid") -> DataFrame:
    """One row with the stage edges as Mermaid or DOT text, in name order."""
    arrow, head, tail = (" --> ", "flowchart TD\n", "") if kind == "mermaid" else (" -> ", "digraph {\n", "\n}")
    line = F.concat(F.lit("    "), F.col("src"), F.lit(arrow), F.col("dst"))
    lines = stage_edges(edges).select(line.alias("line"))
    return lines.agg(F.concat(F.lit(head), F.coalesce(F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.lit("")), F.lit(tail)).alias("text"))


def ready_stages(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """Selected stages without a selected maker."""
    inside = stage_edges(edges).join(selected.select(F.col("stage").alias("src")), "src", "left_semi")
    return selected.join(inside.select(F.col("dst").alias("stage")).distinct(), "stage", "left_anti")


def indexed(df: DataFrame, by: str, name: str = "index") -> DataFrame:
    """1-based place and total of the rows."""
    from weftline.operators.diff import with_position

    placed = with_position(df, [by], name)
    total = placed.agg(F.count(F.lit(1)).alias("total"))
    return placed.withColumn(name, (F.col(name) + 1).cast("int")).join(F.broadcast(total), how="cross")
