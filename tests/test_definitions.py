"""Parameters, configuration, loaders and registration."""

import dataclasses
import types

import pytest

from weftline.operators import config, params
from weftline.operators.params import Params, ParamsError
from weftline.operators.runtime import Output, Pipeline, RegistryError, Stage, fingerprint, module_attributes
from weftline.sources import loaders


class Optimiser(Params):
    rate: float = 0.1
    steps: list = dataclasses.field(default_factory=lambda: [1, 2])


class Train(Params):
    name: str = "m"
    depth: int = 3
    limit: int | None = None
    inner: Optimiser = Optimiser()


class Needs(Params):
    size: int


def test_parameters_resolve_and_are_overridden():
    assert params.resolve_params(None, None, "s") is None
    assert params.resolve_params(None, Train, "s") == params.resolve_params(Train, Train, "s") == Train()
    given = Train(depth=5)
    assert params.resolve_params(given, Train, "s") is given
    for bad, hint in ((Train, None), (Optimiser, Train), (dict, Train), (None, Needs)):
        with pytest.raises(ParamsError):
            params.resolve_params(bad, hint, "s")
    over = {"s": {"depth": 7, "inner": {"steps": [9]}}, "s@b": {"depth": 8, "limit": 4}}
    assert params.effective_values(given, "s@b", over) == {"name": "m", "depth": 8, "limit": 4, "inner": {"rate": 0.1, "steps": [9]}}
    assert params.with_overrides(given, "t", over) is given and params.effective_values(None, "s", over) == {}
    assert params.overrides_for("@x", {"": {"a": 1}, "@x": {"b": 2}}) == {"b": 2}
    for wrong in ({"depth": "7"}, {"depth": True}, {"other": 1}, {"inner": {"rate": "x"}}, {"limit": "x"}):
        with pytest.raises(ParamsError):
            params.with_overrides(given, "s", {"s": wrong})
    assert params.with_overrides(given, "s", {"s": {"inner": {"rate": 1}}}).inner.rate == 1.0
    assert params.defaults_document({"a@1": Optimiser(), "a@2": Optimiser(rate=2.0), "b": None}) == {"a": {"rate": 0.1, "steps": [1, 2]}}


def test_interpolation_keeps_types():
    known = {"n": 3, "flag": True, "d": "x"}
    assert params.interpolated({"a": "${n}", "b": ["${flag}", "${d}/${n}"], "c": 1.5}, known) == {"a": 3, "b": [True, "x/3"], "c": 1.5}
    assert params.interpolated("${other}", known) == "${other}"
    with pytest.raises(ParamsError):
        params.interpolated("a/${other}", known, "s")


def test_variants_of_a_function():
    found = params.expand_variants("train", [{"name": "a", "params": {"depth": 4}}, {}], Train)
    assert [(v["name"], v["params"].depth) for v in found] == [("train@a", 4), ("train@default", 3)]
    for bad in ({"a": 1}, [{"parmas": {}}]):
        with pytest.raises(ParamsError):
            params.expand_variants("train", bad, Train)


def test_configuration_by_dotted_keys():
    doc = {"cache": {"dir": "c"}, "remotes": {"origin": "s3://b/p"}, "core": 5}
    assert config.get_key(doc, "cache.dir") == "c" and config.get_key(doc, "cache.dir.x") is None and config.get_key(doc, "core") == 5
    changed = config.with_key(doc, "core.max_workers", 4)
    assert changed["core"] == {"max_workers": 4} and doc["core"] == 5
    assert config.without_key(changed, "core.max_workers") == ({"cache": {"dir": "c"}, "remotes": {"origin": "s3://b/p"}}, True)
    assert config.without_key(doc, "cache.other") == (doc, False)
    assert config.flat(doc) == {"cache.dir": "c", "remotes.origin": "s3://b/p", "core": 5}
    assert config.layered({"a": {"b": 1}}, {"a": {"b": 2, "c": 3}}, "a.b") == 1 and config.layered({}, {"a": {"c": 3}}, "a.c") == 3
    assert config.checked("diff.max_rows", "12") == 12 and config.checked("cache.checkout_mode", "copy, symlink") == ["copy", "symlink"] and config.checked("remotes.x-1", "s3://b") == "s3://b"
    for key, value in (("nope", 1), ("diff.max_rows", 0), ("remote.retries", -1), ("core.max_workers", 0), ("watch.debounce", "x"), ("cache.checkout_mode", "move"), ("remotes.x", "http://b"), ("remotes.a.b", "s3://b")):
        with pytest.raises(config.ConfigError):
            config.checked(key, value)
    schema = config.json_schema()
    assert schema["properties"]["remote"]["properties"]["retries"] == {"type": "integer", "default": 10, "minimum": 0}


@dataclasses.dataclass(frozen=True)
class Upper(loaders.Loader):
    mark: str = "!"

    def load(self, spark, path):
        return path.upper() + self.mark

    def save(self, data, path):
        pass


class WithEmpty(Upper):
    def empty(self, spark):
        return ""


def test_loaders(spark, tmp_path):
    assert set(loaders.loader_fingerprint(Upper())) == {"loader:Upper:save", "loader:Upper:load", "loader:Upper:config"}
    assert "loader:WithEmpty:empty" in loaders.loader_fingerprint(WithEmpty())
    assert loaders.loader_fingerprint(Upper("?"))["loader:Upper:config"] != loaders.loader_fingerprint(Upper())["loader:Upper:config"]
    missing = str(tmp_path / "none.csv")
    assert loaders.load_dependency(spark, "x", loaders.Dep(("a", "b"), Upper())) == ["A!", "B!"]
    assert loaders.load_dependency(spark, "x", loaders.Dep(missing, loaders.Table("id long"), incremental=True)).columns == ["id"]
    assert loaders.load_dependency(spark, "x", loaders.Dep(missing, WithEmpty(), incremental=True)) == ""
    for dep in (loaders.Dep(missing, Upper(), incremental=True), loaders.Dep(missing, loaders.Text(), incremental=True), loaders.Dep(missing, loaders.Document())):
        with pytest.raises(loaders.LoadError):
            loaders.load_dependency(spark, "x", dep)
    loaders.Table().save(spark.createDataFrame([(1, "a\nb")], "id long, t string"), missing)
    assert loaders.Table().load(spark, missing).collect()[0]["t"] == "a\nb"


class Helper:
    def run(self):
        return inside()


def inside():
    return 1


def uses_class():
    return Helper().run()


tool = types.ModuleType("tool")


def uses_module():
    return tool.sub.attr, tool.other


def test_fingerprints_reach_classes_and_modules():
    assert set(fingerprint(uses_class)) == {"self", "class:Helper", "class:Helper.run", "func:inside"}
    assert module_attributes(uses_module, "tool") == ["sub.attr", "other"]


def noop(spark, inputs, values):
    return None


def test_registration_places_paths_and_takes_overrides():
    pipeline = Pipeline("sub/dir")
    made = pipeline.register(Stage("s", noop, {"a": "in.csv", "b": "/abs"}, {"o": Output("out.csv"), "f": Output("folder/")}, Train), {"a": "other.csv"}, {"o": {"path": "new.csv", "cache": False}, "f": "else/"})
    assert made.deps == {"a": "sub/dir/other.csv", "b": "/abs"} and made.outs["o"] == Output("sub/dir/new.csv", cached=False) and made.outs["f"].path == "sub/dir/else/"
    assert made.values()["depth"] == 3
    for overrides in ({"f": "x"}, {"o": {"cache": True}}, {"nobody": "x"}):
        with pytest.raises(RegistryError):
            pipeline.register(Stage("t", noop, {}, {"o": Output("t.csv"), "f": Output("t/")}), None, overrides)
    assert "loader:Upper:load" in Stage("l", noop, {}, {}, loaders={"a": Upper()}).manifest()


def test_reload_names_what_changed():
    def pipeline(*stages):
        out = Pipeline()
        for s in stages:
            out.register(s)
        return out

    here = pipeline(Stage("a", noop, {}, {"o": Output("x")}), Stage("b", noop, {}, {"o": Output("y")}))
    changed = here.reload(lambda: pipeline(Stage("b", noop, {}, {"o": Output("z")}), Stage("c", noop, {}, {"o": Output("w")})))
    assert changed == {"a": "removed", "b": "modified", "c": "added"} and set(here.stages) == {"b", "c"}
    assert here.reload(lambda: 1 / 0) is None and set(here.stages) == {"b", "c"}
