"""Configuration documents: dotted keys, defaults, validation and a schema."""

from __future__ import annotations

import re
from collections.abc import Mapping

# The keys, their types, defaults and least values (folders are this package's own).
KEYS: dict[str, tuple[str, object, int | None]] = {
    "cache.dir": ("string", ".weftline/cache", None),
    "cache.checkout_mode": ("modes", ["hardlink", "symlink", "copy"], None),
    "core.max_workers": ("integer", -2, None),
    "core.state_dir": ("string", ".weftline", None),
    "core.run_history_retention": ("integer", 100, 1),
    "remote.jobs": ("integer", 20, 1),
    "remote.retries": ("integer", 10, 0),
    "remote.connect_timeout": ("integer", 30, 1),
    "watch.debounce": ("integer", 300, 0),
    "display.precision": ("integer", 5, 0),
    "diff.max_rows": ("integer", 10000, 1),
    "default_remote": ("string", "", None),
}
MODES = ("hardlink", "symlink", "copy")
REMOTE, REMOTE_URL = re.compile(r"remotes\.([A-Za-z0-9_-]+)"), re.compile(r"s3a?://[^/\s]+(?:/\S*)?")

_NOTHING = object()


class ConfigError(ValueError):
    """A key that isn't known, or a value that it can't have."""


def get_key(document: Mapping, key: str, default=None):
    """The value under a dotted key."""
    for part in key.split("."):
        document = document.get(part, _NOTHING) if isinstance(document, Mapping) else _NOTHING
        if document is _NOTHING:
            return default
    return document


def with_key(document: Mapping, key: str, value) -> dict:
    """The document with a dotted key set; what stands in the way and isn't a mapping is replaced."""
    first, _, rest = key.partition(".")
    if not first:
        raise ConfigError("a key can't be empty")
    inner = document.get(first) if isinstance(document, Mapping) else None
    return {**document, first: with_key(inner if isinstance(inner, Mapping) else {}, rest, value) if rest else value}


def without_key(document: Mapping, key: str) -> tuple[dict, bool]:
    """The document without a dotted key and without the mappings that this leaves empty, and whether it was there."""
    first, _, rest = key.partition(".")
    if first not in document:
        return dict(document), False
    if not rest:
        return {k: v for k, v in document.items() if k != first}, True
    if not isinstance(document[first], Mapping):
        return dict(document), False
    inner, found = without_key(document[first], rest)
    kept = {**document, first: inner} if inner or not found else {k: v for k, v in document.items() if k != first}
    return kept, found


def layered(lock: Mapping, params: Mapping, key: str):
    """The value of a dotted key in a lock record, else in the parameters."""
    return get_key(lock, key, get_key(params, key))


def flat(document: Mapping, prefix: str = "") -> dict:
    """Dotted keys and their values; the mapping of remotes is one level of names."""
    out: dict = {}
    for key, value in document.items():
        if isinstance(value, Mapping) and prefix + key != "remotes":
            out |= flat(value, f"{prefix}{key}.")
        elif isinstance(value, Mapping):
            out |= {f"remotes.{name}": url for name, url in value.items()}
        else:
            out[prefix + key] = value
    return out


def checked(key: str, value):
    """The value as its key takes it. Raises ConfigError."""
    if key.startswith("remotes."):
        if not REMOTE.fullmatch(key):
            raise ConfigError(f"bad remote name in {key!r}")
        if not isinstance(value, str) or not REMOTE_URL.fullmatch(value):
            raise ConfigError(f"{key!r} must be an s3 address")
        return value
    if key not in KEYS:
        raise ConfigError(f"unknown key {key!r}")
    kind, _, least = KEYS[key]
    if kind == "string":
        return str(value)
    if kind == "modes":
        modes = [m.strip() for m in value.split(",") if m.strip()] if isinstance(value, str) else list(value)
        if not modes or set(modes) - set(MODES):
            raise ConfigError(f"{key!r} takes {', '.join(MODES)}")
        return modes
    try:
        number = int(value) if not isinstance(value, (bool, float)) else None
    except (TypeError, ValueError):
        number = None
    if key == "core.max_workers" and number == 0:
        raise ConfigError(f"{key!r} can't be 0")
    if number is None or (least is not None and number < least):
        raise ConfigError(f"{key!r} must be an integer" + (f" of at least {least}" if least is not None else ""))
    return number


def json_schema() -> dict:
    """A JSON schema of the configuration."""
    out: dict = {"type": "object", "properties": {"remotes": {"type": "object", "additionalProperties": {"type": "string"}}}, "additionalProperties": False}
    for key, (kind, default, least) in KEYS.items():
        section, _, name = key.rpartition(".")
        place = out["properties"].setdefault(section, {"type": "object", "properties": {}, "additionalProperties": False})["properties"] if section else out["properties"]
        entry: dict = {"type": "array", "items": {"enum": list(MODES)}} if kind == "modes" else {"type": kind}
        if default is not None:
            entry["default"] = default
        if least is not None:
            entry["minimum"] = least
        place[name] = entry
    return out
