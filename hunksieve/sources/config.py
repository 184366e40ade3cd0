"""Configuration files: environment, includes, presets, directory overrides."""

from __future__ import annotations

import json
import os
import re
import tomllib
from collections.abc import Callable, Iterable
from dataclasses import MISSING, dataclass, field, fields, is_dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CONFIG_FILE
from ..operators.rules import Rule, merge
from .presets import BUILT_IN, PRESETS

MOST_INCLUDES = 10


class ConfigError(ValueError):
    """A configuration that can't be read."""


@dataclass(frozen=True)
class Defaults:
    base: str | None = None
    head: str | None = None
    scope: str | None = None
    fail_on: str | None = None
    max_findings: int | None = None
    diff_context: int | None = None

    def over(self, below: Defaults) -> Defaults:
        """These values, and those of `below` where there is none."""
        return Defaults(*(getattr(self, f.name) if getattr(self, f.name) is not None else getattr(below, f.name) for f in fields(self)))


#: What holds where nothing is configured.
STANDARD = Defaults("origin/main", "HEAD", "added", "error", 200, 0)


@dataclass(frozen=True)
class Config:
    defaults: Defaults = STANDARD
    rules: tuple[Rule, ...] = field(default=())


VARIABLE = r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}"


def expand_env(text: str, env: dict[str, str] | None = None) -> str:
    """`${NAME}` and `${NAME:-default}`, where the default is for names that aren't set; others are an error."""
    env = dict(os.environ) if env is None else env

    def value(m: re.Match) -> str:
        if m[1] in env:
            return env[m[1]]
        if m[2] is None:
            raise ConfigError(f"environment variable {m[1]} is not set")
        return m[2]

    return re.sub(VARIABLE, value, text)


def _parse(text: str, where: str) -> tuple[list[str], Defaults, list[Rule]]:
    try:
        data = tomllib.loads(text)
        return list(data.get("includes", [])), Defaults(**data.get("defaults", {})), [Rule.of(r) for r in data.get("rule", [])]
    except (tomllib.TOMLDecodeError, TypeError, ValueError) as e:
        raise ConfigError(f"{where}: {e}") from e


def load_config(path: str | Path, env: dict[str, str] | None = None) -> Config:
    """A configuration with its includes, whose paths are relative to the file that names them.

    Includes come first, in order, and later rules of an id and later default values win. A file may be included on
    several ways, but not by itself, and not more than ten levels deep.
    """
    read: dict[Path, tuple[list[str], Defaults, list[Rule]]] = {}

    def load(path: Path, above: tuple[Path, ...]) -> tuple[Defaults, list[Rule]]:
        path = path.resolve()
        if path in above:
            raise ConfigError(f"{path} includes itself")
        if len(above) > MOST_INCLUDES:
            raise ConfigError(f"{path}: more than {MOST_INCLUDES} levels of includes")
        if path not in read:
            try:
                read[path] = _parse(expand_env(path.read_text(encoding="utf-8"), env), str(path))
            except OSError as e:
                raise ConfigError(f"{path}: {e.strerror}") from e
        includes, defaults, rules = read[path]
        below, merged = Defaults(), {}
        for name in includes:
            d, rs = load(path.parent / name, (*above, path))
            below, merged = d.over(below), merged | {r.id: r for r in rs}
        return defaults.over(below), list((merged | {r.id: r for r in rules}).values())

    defaults, rules = load(Path(path), ())
    return Config(defaults.over(STANDARD), tuple(rules))


def effective(config: Config | None, built_in: bool = True) -> Config:
    """A configuration over the built-in rules; its rules win by id."""
    own = config or Config()
    return replace(own, rules=tuple(merge(BUILT_IN, own.rules))) if built_in else own


def preset(name: str) -> Config:
    if name not in PRESETS:
        raise ConfigError(f"no preset {name}; there are {', '.join(PRESETS)}")
    return Config(STANDARD, tuple(PRESETS[name]))


def config_text(config: Config) -> str:
    """A configuration as the text of a file that `load_config` reads back to the same; only what differs from the defaults is named.

    Texts are JSON strings, which TOML reads as well. A text that looks like `${NAME}` can't be kept from being expanded, so it's an error.
    """

    def text(value: object) -> str:
        if isinstance(value, tuple):
            return "[" + ", ".join(map(text, value)) + "]"
        if is_dataclass(value):
            return "{" + ", ".join(f"{k} = {v}" for k, v in lines(value)) + "}"
        return json.dumps(value, ensure_ascii=False).replace("\x7f", "\\u007f")

    def lines(value: object) -> list[tuple[str, str]]:
        return [(f.name, text(v)) for f in fields(value) if (v := getattr(value, f.name)) is not None and (f.default is MISSING or v != f.default)]

    tables = [("[defaults]", config.defaults), *(("[[rule]]", r) for r in config.rules)]
    out = "\n".join("\n".join([head, *(f"{k} = {v}" for k, v in lines(table))]) + "\n" for head, table in tables)
    if re.search(VARIABLE, out):
        raise ConfigError("a text looks like an environment variable")
    return out


def directories_above(lines: DataFrame) -> DataFrame:
    """(directory): all directories that hold a path of `lines`, up to the root, which is empty."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return lines.select("path").distinct().select(F.explode(above).alias("directory")).distinct()


def parse_overrides(files: Iterable[tuple[str, str]]) -> list[dict]:
    """Overrides of (directory, text of its file), shallow ones first."""
    out = []
    for folder, text in sorted(files, key=lambda x: (x[0].count("/") + (x[0] != ""), x[0])):
        for r in tomllib.loads(text).get("rule", []):
            out.append({"directory": folder, "rule_id": r["id"], "enabled": r.get("enabled"), "severity": r.get("severity"), "exclude_paths": r.get("exclude_paths", [])})
    return out


def load_overrides(lines: DataFrame, read: Callable[[str], str | None] | str | Path) -> list[dict]:
    """Overrides of the directories that the lines touch, from CONFIG_FILE in each; `read` gives a path's text or None."""
    if not callable(read):
        root = Path(read)
        read = lambda p: (root / p).read_text(encoding="utf-8") if (root / p).is_file() else None
    folders = [r.directory for r in directories_above(lines).collect()]  # directories of a change, not lines
    texts = [(d, read(f"{d}/{CONFIG_FILE}" if d else CONFIG_FILE)) for d in folders]
    return parse_overrides((d, t) for d, t in texts if t is not None)
