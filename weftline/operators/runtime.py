"""Stages as Python functions over DataFrames: registry, fingerprints and a scheduler on the driver.

A stage is ``fn(spark, inputs, params) -> DataFrame | dict``. What decides whether it runs
again is its fingerprint (its code and that of the helpers it calls), its parameters and
its inputs. Stages that are ready run as concurrent Spark jobs.
"""

from __future__ import annotations

import ast
import hashlib
import inspect
import json
import random
import textwrap
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from weftline.functions.scalars import LONGEST_STAGE_NAME, STAGE_NAME_PATTERN
from weftline.operators.params import Params, resolve_params
from weftline.schemas import SCHEMAS
from weftline.sources.loaders import Reader, Writer, loader_fingerprint


#: The path of an input that is named later.
PLACEHOLDER = "?"


class RegistryError(ValueError):
    """A stage that can't be registered."""


@dataclass(frozen=True)
class Output:
    """A named output: data, metric or plot; incremental ones are read before they are written."""

    path: str
    kind: str = "data"
    cached: bool = True
    incremental: bool = False


@dataclass(frozen=True)
class Stage:
    name: str
    fn: Callable
    deps: dict[str, str]
    outs: dict[str, Output]
    params: dict | Params | None = field(default_factory=dict)
    mutex: tuple[str, ...] = ()
    variant: str = ""
    loaders: dict[str, Reader | Writer] = field(default_factory=dict)

    def values(self) -> dict:
        """Parameter values."""
        return self.params.values() if isinstance(self.params, Params) else dict(self.params or {})

    def manifest(self) -> dict[str, str]:
        """Fingerprints of the function and of the loaders that it uses."""
        out = fingerprint(self.fn)
        for loader in self.loaders.values():
            out |= loader_fingerprint(loader)
        return out


class _Normal(ast.NodeTransformer):
    """Drops what doesn't change what code does: documentation and the function's own name."""

    def _plain(self, node):
        self.generic_visit(node)
        first = node.body[0] if node.body else None
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            node.body = node.body[1:] or [ast.Pass()]
        return node

    def visit_FunctionDef(self, node):
        node.name = "f"
        return self._plain(node)

    visit_AsyncFunctionDef = visit_FunctionDef
    visit_ClassDef = _plain


def code_hash(fn: Callable) -> str:
    """A hash of the function's syntax tree, so comments, layout, documentation and its name don't matter."""
    try:
        tree = _Normal().visit(ast.parse(textwrap.dedent(inspect.getsource(fn))))
        text = ast.dump(tree, annotate_fields=False)
    except (OSError, TypeError, SyntaxError):
        code = getattr(fn, "__code__", None)
        if code is None:  # a class without source
            return value_hash((fn.__module__, fn.__qualname__))
        text = f"{code.co_code.hex()} {code.co_consts!r} {code.co_names!r}"
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def value_hash(value) -> str:
    """A hash of how a plain value is written."""
    return hashlib.sha256(repr(value).encode()).hexdigest()[:16]


def is_user_code(value) -> bool:
    """Whether a function or class comes from neither the standard library nor an installed package."""
    file = getattr(inspect.getmodule(value), "__file__", None)
    return file is None or not any(part in file for part in ("site-packages", "dist-packages", "/lib/python"))


def fingerprint(fn: Callable) -> dict[str, str]:
    """Hashes of a function and, by name, of all helpers and classes it reaches and of the plain values it closes over."""
    manifest: dict[str, str] = {}
    seen: set[int] = set()

    def add(value, name: str, prefixes: tuple[str, str, str]) -> None:
        if inspect.isfunction(value) and is_user_code(value):
            visit(value, f"{prefixes[0]}:{name}")
        elif inspect.isclass(value) and is_user_code(value):
            visit_class(value, f"{prefixes[1]}:{name}")
        elif isinstance(value, (str, int, float, bool, bytes, tuple, frozenset, type(None))):
            manifest[f"{prefixes[2]}:{name}"] = value_hash(value)

    def visit(f: Callable, name: str) -> None:
        if id(f) in seen:
            return
        seen.add(id(f))
        manifest[name] = code_hash(f)
        used = inspect.getclosurevars(f)
        for key, value in sorted({**used.globals, **used.nonlocals}.items()):
            if inspect.ismodule(value):
                for path in sorted(module_attributes(f, key)):
                    member = value
                    for attr in path.split("."):
                        step = getattr(member, attr, None)
                        if step is None or not (inspect.ismodule(member) or inspect.isclass(member)):
                            break
                        member = step
                    if member is not value and not inspect.ismodule(member) and is_user_code(value):
                        add(member, f"{key}.{path}", ("mod", "mod", "mod"))
            else:
                add(value, key, ("func", "class", "const"))

    def visit_class(cls: type, name: str) -> None:
        if id(cls) in seen:
            return
        seen.add(id(cls))
        manifest[name] = code_hash(cls)
        for base in cls.__bases__:
            if is_user_code(base) and base is not object:
                visit_class(base, f"class:{base.__name__}")
        for key, member in sorted(vars(cls).items()):
            member = getattr(member, "__func__", getattr(member, "fget", member))
            if inspect.isfunction(member) and member.__module__ == cls.__module__:
                visit(member, f"{name}.{key}")

    visit(fn, "self")
    return manifest


def module_attributes(fn: Callable, module: str) -> list[str]:
    """What of a module a function's code uses, as dotted names (``sub.attr`` for ``module.sub.attr``), in the order of first use."""
    try:
        tree = ast.parse(textwrap.dedent(inspect.getsource(fn)))
    except (OSError, SyntaxError):
        return []
    inner, found = set(), []
    for node in ast.walk(tree):
        parts, at = [], node
        while isinstance(at, ast.Attribute):
            parts.append(at.attr)
            at = at.value
            inner.add(id(at))
        if parts and isinstance(at, ast.Name) and at.id == module and id(node) not in inner:
            found.append((node.lineno, node.col_offset, ".".join(reversed(parts))))
    return list(dict.fromkeys(name for _, _, name in sorted(found)))


def placed(path: str, root: str) -> str:
    """The path below a pipeline's folder, unless it is absolute or an address."""
    return path if not root or path.startswith("/") or "://" in path else f"{root.rstrip('/')}/{path.removeprefix('./')}"


def overridden(out: Output, override: str | dict | None) -> Output:
    """An output with another path, or with the path and options of a mapping. A folder stays one."""
    if override is None:
        return out
    given = {"path": override} if isinstance(override, str) else override
    if "path" not in given:
        raise RegistryError(f"the override of {out.path!r} has no path")
    if out.path.endswith("/") and not given["path"].endswith("/"):
        raise RegistryError(f"{given['path']!r} must end in / as {out.path!r} is a folder")
    return replace(out, path=given["path"], cached=given.get("cache", out.cached))


class Pipeline:
    """A registry of stages."""

    def __init__(self, root: str = "") -> None:
        self.root = root
        self.stages: dict[str, Stage] = {}

    def register(self, stage: Stage, dep_paths: dict[str, str] | None = None, out_overrides: dict[str, str | dict] | None = None) -> Stage:
        """Add a stage, with other paths and options for some inputs and outputs; its names, outputs and incremental outputs are checked.

        Relative paths lie in the pipeline's folder. A parameter class becomes its defaults.
        """
        import re

        for given, known, what in ((dep_paths, stage.deps, "inputs"), (out_overrides, stage.outs, "outputs")):
            if unknown := set(given or {}) - set(known):
                raise RegistryError(f"stage {stage.name!r} has no {what} {sorted(unknown)}")
        deps = {n: p if p == PLACEHOLDER else placed(p, self.root) for n, p in {**stage.deps, **(dep_paths or {})}.items()}
        outs = {n: overridden(o, (out_overrides or {}).get(n)) for n, o in stage.outs.items()}
        outs = {n: replace(o, path=placed(o.path, self.root)) for n, o in outs.items()}
        params = resolve_params(stage.params, Params, stage.name) if isinstance(stage.params, type) else stage.params
        stage = replace(stage, deps=deps, outs=outs, params=params)
        if not re.match(STAGE_NAME_PATTERN, stage.name) or len(stage.name) > LONGEST_STAGE_NAME:
            raise RegistryError(f"bad stage name {stage.name!r}")
        if stage.name in self.stages:
            raise RegistryError(f"stage {stage.name!r} is registered already")
        taken = {o.path.rstrip("/"): s.name for s in self.stages.values() for o in s.outs.values()}
        for out in stage.outs.values():
            path = out.path.rstrip("/")
            for other, owner in taken.items():
                if path == other or path.startswith(other + "/") or other.startswith(path + "/"):
                    raise RegistryError(f"output {out.path!r} overlaps {other!r} of stage {owner!r}")
            if out.incremental and out.path not in stage.deps.values():
                raise RegistryError(f"incremental output {out.path!r} must be an input too")
        self.stages[stage.name] = stage
        return stage

    def stage(self, name: str, deps: dict[str, str] | None = None, outs: dict[str, Output] | None = None, params: dict | None = None, mutex: tuple[str, ...] = ()):
        """A decorator that registers a function."""

        def add(fn: Callable) -> Callable:
            self.register(Stage(name, fn, deps or {}, outs or {}, params or {}, mutex))
            return fn

        return add

    def bind(self, name: str, deps: dict[str, str]) -> None:
        """Give placeholders (inputs whose path is PLACEHOLDER) their paths."""
        stage = self.stages[name]
        if unknown := set(deps) - set(stage.deps):
            raise RegistryError(f"unknown inputs {sorted(unknown)}")
        self.stages[name] = replace(stage, deps={**stage.deps, **deps})

    def snapshot(self) -> dict[str, Stage]:
        return dict(self.stages)

    def restore(self, stages: dict[str, Stage]) -> None:
        self.stages = dict(stages)

    def reload(self, load: Callable[[], Pipeline]) -> dict[str, str] | None:
        """Take the stages of a pipeline that is made anew after its code changed; added, removed and modified ones by name.

        All of its stages are to be decided on again. If it can't be made, or depends on
        itself, the stages stay as they are and the result is None.
        """
        try:
            fresh = load()
            fresh.makers()
            after = {n: (s.manifest(), s.values(), s.deps, s.outs) for n, s in fresh.stages.items()}
        except Exception:
            return None
        before = {n: (s.manifest(), s.values(), s.deps, s.outs) for n, s in self.stages.items()}
        self.stages = dict(fresh.stages)
        kinds = {n: "added" if n not in before else "removed" if n not in after else "modified" if before[n] != after[n] else "" for n in sorted({*before, *after})}
        return {n: kind for n, kind in kinds.items() if kind}

    def to_table(self, spark: SparkSession) -> DataFrame:
        """The stages as a catalogue table."""
        rows = []
        for s in self.stages.values():
            own = {o.path for o in s.outs.values() if o.incremental}
            outs = [(o.path, o.kind, o.cached, o.incremental) for o in s.outs.values()]
            rows.append((s.name, s.variant, list(s.mutex), [d for d in s.deps.values() if d not in own], outs, s.manifest(), json.dumps(s.values(), sort_keys=True)))
        return spark.createDataFrame(rows, SCHEMAS["stages"])

    def makers(self) -> dict[str, set[str]]:
        """For each stage the stages whose outputs it reads. Raises RegistryError on a cycle."""
        made = {o.path.rstrip("/"): s.name for s in self.stages.values() for o in s.outs.values()}
        out: dict[str, set[str]] = {}
        for s in self.stages.values():
            paths = [d.rstrip("/") for d in s.deps.values()]
            out[s.name] = {owner for p in paths for m, owner in made.items() if owner != s.name and (p == m or p.startswith(m + "/") or m.startswith(p + "/"))}
        placed: set[str] = set()
        while len(placed) < len(out):
            ready = {n for n, need in out.items() if n not in placed and need <= placed}
            if not ready:
                raise RegistryError(f"stages {sorted(set(out) - placed)} depend on each other")
            placed |= ready
        return out

    def run(
        self,
        spark: SparkSession,
        load: Callable[[str], DataFrame | None],
        save: Callable[[str, DataFrame], None],
        targets: list[str] | None = None,
        skip: Callable[[Stage], bool] = lambda s: False,
        workers: int = 4,
        keep_going: bool = False,
    ) -> dict[str, tuple[str, str]]:
        """Run the targets and what they need; returns status and reason by stage.

        After a failure nothing more starts, or, with ``keep_going``, only what depends on it.
        """
        makers = self.makers()
        wanted = set(targets or self.stages)
        if unknown := wanted - set(self.stages):
            raise RegistryError(f"unknown stages {sorted(unknown)}")
        while more := {m for n in wanted for m in makers[n]} - wanted:
            wanted |= more
        results: dict[str, tuple[str, str]] = {}
        running: dict[Future, Stage] = {}

        def blocked_by(name: str) -> str | None:
            bad = sorted(n for n, (status, _) in results.items() if status in ("failed", "blocked"))
            return next((n for n in bad if not keep_going or n in makers[name]), None)

        def free(stage: Stage) -> bool:
            held = {m for s in running.values() for m in s.mutex}
            if "*" in held or ("*" in stage.mutex and running):
                return False
            return not held & set(stage.mutex)

        with ThreadPoolExecutor(max(1, min(workers, len(wanted)))) as pool:
            while len(results) < len(wanted):
                for name in sorted(wanted - set(results) - {s.name for s in running.values()}):
                    stage = self.stages[name]
                    if culprit := blocked_by(name):
                        results[name] = ("blocked" if keep_going else "skipped", f"upstream '{culprit}' failed")
                    elif makers[name] & wanted <= {n for n, (status, _) in results.items() if status in ("ran", "skipped")} and len(running) < workers and free(stage):
                        running[pool.submit(self._execute, spark, stage, load, save, skip)] = stage
                if not running:
                    continue
                done, _ = wait(running, return_when=FIRST_COMPLETED)
                for future in done:
                    stage = running.pop(future)
                    error = future.exception()
                    results[stage.name] = ("failed", str(error)) if error else future.result()
        return results

    @staticmethod
    def _execute(spark: SparkSession, stage: Stage, load, save, skip) -> tuple[str, str]:
        if skip(stage):
            return "skipped", "unchanged"
        seed()
        made = stage.fn(spark, {name: load(path) for name, path in stage.deps.items()}, stage.params)
        outputs = made if isinstance(made, dict) else {next(iter(stage.outs)): made} if stage.outs else {}
        if missing := set(stage.outs) - set(outputs):
            raise KeyError(f"stage {stage.name!r} didn't return {sorted(missing)}")
        for name, out in stage.outs.items():  # all were checked before the first is written
            save(out.path, outputs[name])
        return "ran", ""


def seed(value: int = 0) -> None:
    """The same random numbers in every run of a stage."""
    import numpy as np

    random.seed(value)
    np.random.seed(value)
