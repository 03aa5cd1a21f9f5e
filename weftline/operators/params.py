"""Parameters of stages: classes with defaults, what they resolve to, overrides, and their values in a snapshot."""

from __future__ import annotations

import copy
import dataclasses
import re
import typing
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ParamsError(ValueError):
    """Parameters that can't be made, or that don't fit."""


class Params:
    """Base of parameter classes. Annotated names are fields; a field without a default is required; nested classes are Params too."""

    def __init_subclass__(cls, **options):
        super().__init_subclass__(**options)
        dataclasses.dataclass(frozen=True, kw_only=True)(cls)

    def values(self) -> dict:
        """All values, those of nested parameters as mappings."""
        return dataclasses.asdict(self)

    @classmethod
    def build(cls, values: Mapping, where: str = ""):
        """An instance from a mapping; unknown or missing names and values of another type raise ParamsError."""
        hints = typing.get_type_hints(cls)
        known = {f.name: f for f in dataclasses.fields(cls)}
        if unknown := sorted(set(values) - set(known)):
            raise ParamsError(f"{where}unknown parameters {unknown}")
        out = {}
        for name, field in known.items():
            if name in values:
                out[name] = _fitted(values[name], hints[name], f"{where}{name}")
            elif field.default is dataclasses.MISSING and field.default_factory is dataclasses.MISSING:
                raise ParamsError(f"{where}parameter {name!r} is missing")
        return cls(**out)


def _fitted(value, hint, where: str):
    """The value as the hinted type; whole numbers fit floats, and nothing else is converted."""
    if isinstance(hint, type) and issubclass(hint, Params):
        if isinstance(value, hint):
            return value
        if isinstance(value, Mapping):
            return hint.build(value, f"{where}.")
    elif hint is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    elif hint in (int, float, str, bool):
        if type(value) is hint:
            return value
    else:
        options = typing.get_args(hint) if typing.get_origin(hint) not in (list, dict, tuple, set) else ()
        if options:
            for option in options:
                try:
                    return _fitted(value, option, where)
                except ParamsError:
                    continue
        else:
            plain = typing.get_origin(hint) or hint
            if not isinstance(plain, type) or isinstance(value, plain):
                return value
    raise ParamsError(f"{where}: {value!r} isn't {getattr(hint, '__name__', hint)}")


def merged(base: Mapping, over: Mapping) -> dict:
    """Values of both, mappings merged, anything else (lists too) replaced; nothing is shared with the arguments."""
    out = copy.deepcopy(dict(base))
    for key, value in over.items():
        both = isinstance(value, Mapping) and isinstance(out.get(key), Mapping)
        out[key] = merged(out[key], value) if both else copy.deepcopy(value)
    return out


def overrides_for(stage: str, overrides: Mapping[str, Mapping] | None) -> dict:
    """Overrides of a stage: those of its base name, then those of the exact variant."""
    layers = [stage.partition("@")[0], stage] if "@" in stage else [stage]
    out: dict = {}
    for name in layers:
        out = merged(out, (overrides or {}).get(name, {}) if name else {})
    return out


def resolve_params(given, hint: type | None, stage: str):
    """The instance that a stage runs with: the one given, else the class given, else the class that the function names, by their defaults.

    ``hint`` is the class that the function's parameter names, None if it has none.
    """
    if given is None and hint is None:
        return None
    if given is not None and hint is None:
        raise ParamsError(f"stage {stage!r}: parameters are given but the function takes none")
    cls = hint if given is None else given if isinstance(given, type) else type(given)
    if not issubclass(cls, Params):
        raise ParamsError(f"stage {stage!r}: {cls.__name__} isn't a Params class")
    if not issubclass(cls, hint):
        raise ParamsError(f"stage {stage!r}: {cls.__name__} isn't {hint.__name__}")
    return given if isinstance(given, Params) else cls.build({}, f"stage {stage!r}: ")


def with_overrides(instance: Params | None, stage: str, overrides: Mapping[str, Mapping] | None = None) -> Params | None:
    """A new instance with the stage's overrides merged in; the same one if there are none."""
    own = overrides_for(stage, overrides)
    return type(instance).build(merged(instance.values(), own), f"stage {stage!r}: ") if instance is not None and own else instance


def effective_values(instance: Params | None, stage: str, overrides: Mapping[str, Mapping] | None = None) -> dict:
    """What a stage will run with, for change detection and dry runs."""
    found = with_overrides(instance, stage, overrides)
    return {} if found is None else found.values()


def defaults_document(stages: Mapping[str, Params | None]) -> dict[str, dict]:
    """A parameter file with the values of all stages that have parameters, by base name; the first variant's count."""
    out: dict[str, dict] = {}
    for stage, instance in stages.items():
        if instance is not None:
            out.setdefault(stage.partition("@")[0], instance.values())
    return out


def interpolated(value, variables: Mapping[str, object], stage: str | None = None):
    """The value with ``${name}`` replaced, in lists and mappings too.

    A text that is one name alone becomes the variable with its type. With a stage, a name
    that is left raises ParamsError.
    """
    if isinstance(value, Mapping):
        return {k: interpolated(v, variables, stage) for k, v in value.items()}
    if isinstance(value, list):
        return [interpolated(v, variables, stage) for v in value]
    if not isinstance(value, str):
        return value
    alone = re.fullmatch(r"\$\{([^{}]+)\}", value)
    if alone and alone[1] in variables:
        return variables[alone[1]]
    text = value
    for name, known in variables.items():
        text = text.replace("${" + name + "}", str(known))
    if stage is not None and (left := re.findall(r"\$\{(\w+)\}", text)):
        raise ParamsError(f"stage {stage!r}: unresolved {left} in {value!r}")
    return text


#: Keys of a variant that a function returns.
VARIANT_KEYS = ("name", "deps", "outs", "params", "mutex")


def expand_variants(stage: str, variants, hint: type | None = None) -> list[dict]:
    """name, variant, deps, outs, params and mutex of each variant that a function has returned; one without a name is ``default``."""
    if not isinstance(variants, (list, tuple)):
        raise ParamsError(f"stage {stage!r}: variants must be a list, not {type(variants).__name__}")
    out = []
    for given in variants:
        if unknown := sorted(set(given) - set(VARIANT_KEYS)):
            raise ParamsError(f"stage {stage!r}: unknown variant keys {unknown}, known are {sorted(VARIANT_KEYS)}")
        variant = given.get("name", "default")
        name = f"{stage}@{variant}"
        values = given.get("params", {})
        params = hint.build(values, f"stage {name!r}: ") if hint else resolve_params(values or None, None, name)
        out.append({"name": name, "variant": variant, "deps": dict(given.get("deps", {})), "outs": dict(given.get("outs", {})), "params": params, "mutex": list(given.get("mutex", []))})
    return out


def params_at(locks: DataFrame, snapshot: str, stages: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """(stage, params) that lock records (snapshot, stage, params) hold in a snapshot, empty ones aside, and whether that snapshot is known at all."""
    there = locks.where(F.col("snapshot") == snapshot)
    found = there if stages is None else there.join(stages.select("stage").distinct(), "stage", "left_semi")
    return found.where("params is not null and params not in ('', '{}', 'null')").select("stage", "params"), not there.isEmpty()
