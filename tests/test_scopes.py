"""Globs, rules and overrides in tables against the same one by one."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hunksieve.functions import patterns
from hunksieve.operators import evaluate, packs, rules, scopes
from hunksieve.operators.rules import Rule

from .test_rules import GLOBS, lines

ODD = ["**", "**/", "/**", "*", "a//b", "/x*", "x/**/", "**/**", "a/**/b", "***/b", "a**/b", "{a/,}b", "{**/a,b}/c", "[/]b", "[]a]b", r"a\/b", r"\{a*", "a,b*", ".*", "*.", "é?*.日本.*", "a[!{].x", "a/b.c", "**/lib_é*", "{[}],q}.z"]
PATHS = ["", "/", "a", "b", "a/b", "a//b", "/x", "/x/y", "x/", "x/a/", "x/a/b", "a/q/b", "a/b/c", "b/c", "c", "]b", "{a1", "a,bc", ".git", "d/.git", "a.", "éx.日本.md", "ax}.x", "a}.x", "a/b.c", "q/lib_éx", "lib_é", "}.z", "q.z", "a/}.z"]


def matches(glob, path):
    return re.match(patterns.glob_regex(glob).replace(r"\z", r"\Z"), path) is not None


def test_glob_matches(spark):
    rng = random.Random(31)
    part = lambda: "".join(rng.choices(["a", "b", "lib", "x.y", ".", "*", "?", "**", "[ab]", "{a,b/c}", "é"], k=rng.randrange(1, 4)))
    globs = ODD + [g for g, *_ in GLOBS] + ["/".join(rng.choice([part(), "**", "lib"]) for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    paths = PATHS + [p for _, yes, no in GLOBS for p in yes + no] + ["/".join("".join(rng.choices(["a", "b", "lib", "x.y", ".", "é", "c"], k=rng.randrange(1, 4))) for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    frame = lambda name, values: spark.createDataFrame([(v,) for v in [*values, *values[:9], None]], f"{name} string")
    want = {(p, g) for g in globs for p in paths if matches(g, p)}
    got = [tuple(r) for r in scopes.glob_matches(frame("path", paths), frame("glob", globs)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {bool(patterns.glob_keys(g)) for _, g in want} == {True, False}
    assert scopes.glob_matches(frame("path", paths), frame("glob", globs).limit(0)).count() == 0
    assert scopes.glob_matches(frame("path", paths).limit(0), frame("glob", globs)).count() == 0
    with pytest.raises(Exception, match="unclosed class"):
        scopes.glob_matches(frame("path", ["a"]), frame("glob", ["[a"])).collect()


def test_rules_in_scope(spark):
    pack = [
        Rule("all", "info", "", patterns=("x",)),
        Rule("rust", "warn", "", patterns=("x",), paths=("**/*.rs", "src/**"), exclude_paths=("**/gen/**", "*.md")),
        Rule("spoken", "error", "", patterns=("x+",), languages=("Python", "RUST")),
        Rule("out", "info", "", patterns=("x y",), exclude_paths=("**",)),
    ]
    rows = [(p, n, t) for p in ("a.rs", "src/b.py", "src/gen/c.rs", "d.md", "src/e.md", "noext") for n, t in ((1, "x y"), (2, "xx"), (3, "none"))]
    given, table = lines(spark, rows), rules.rules_table(spark, pack)
    each = evaluate.applicable(given, pack).select("path", F.posexplode("severities").alias("i", "s")).where("s is not null").collect()
    want = {(r.path, pack[r.i].id, r.s) for r in each}
    got = [tuple(r) for r in scopes.applicable_table(given, table).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    forced = {r.path for r in scopes.applicable_table(given, table, language="Rust").where("rule_id = 'spoken'").collect()}
    assert len(forced) == 6

    specs = [{"directory": "src", "rule_id": "rust", "severity": "error", "exclude_paths": ["b.*"]}, {"directory": "", "rule_id": "spoken", "enabled": False}, {"directory": "src/gen", "rule_id": "spoken", "enabled": True}]
    overrides = spark.createDataFrame([(i, o["directory"], o["rule_id"], o.get("enabled"), o.get("severity"), o.get("exclude_paths")) for i, o in enumerate(specs)], OVERRIDES)
    key = lambda r: (r.path, r.line, r.rule_id, r.severity, r.start, r.match_text)
    for how in ({}, {"overrides": True}):
        got = scopes.in_scope(packs.find_in_pack(given, table), table, **({"overrides": overrides} if how else {}))
        want = evaluate.find_events(given, pack, **({"overrides": specs} if how else {}))
        assert Counter(map(key, got.collect())) == Counter(map(key, want.collect()))
    bare = table.select("id", "severity", "patterns")
    assert scopes.in_scope(packs.find_in_pack(given, bare), bare).count() == packs.find_in_pack(given, bare).count()


OVERRIDES = "seq long, directory string, rule_id string, enabled boolean, severity string, exclude_paths array<string>"


def test_overrides_in_tables(spark):
    """Random overrides, in any order, against the list of expressions."""
    rng = random.Random(32)
    folders = ["", ".", "a", "./a/", "a/b", "/a/b/", "a\\b", "b", "a/b/c"]
    globs = ["*.py", "/b/**", "./c/*", "b\\**", "**/x.*", "/**", "g/**"]
    paths = ["a/x.py", "a/b/x.rs", "./a/b/c/y.py", "a\\b\\g\\z", "b/x.py", "b/c/q", "x.rs", "a", "/a/b/g/h.py"]
    specs = [{"directory": rng.choice(folders), "rule_id": rng.choice("rst"), "enabled": rng.choice([None, True, False]), "severity": rng.choice([None, "", "info", "warn", "error"]), "exclude_paths": rng.choice([None, [], rng.sample(globs, 1), rng.sample(globs, 2)])} for _ in range(40)]
    frame = spark.createDataFrame([(p,) for p in paths + paths], "path string")
    for some in (specs[:3], specs[3:8], specs[8:16], specs[16:]):
        rows = [(i, o["directory"], o["rule_id"], o["enabled"], o["severity"], o["exclude_paths"]) for i, o in enumerate(some)]
        rng.shuffle(rows)
        got = [tuple(r) for r in scopes.resolve_overrides_table(frame, spark.createDataFrame(rows, OVERRIDES)).collect()]
        said = evaluate.override_specs(some)
        ids = sorted({o["rule_id"] for o in some})
        columns = [F.struct(*evaluate.resolve_overrides(F.col("path"), i, said)).alias(i) for i in ids]
        told = {(r.path, i): tuple(r[i]) for r in frame.select("path", *columns).collect() for i in ids}
        assert len(got) == len({g[:2] for g in got})
        met = {(p, i): told[p, i] for p, i, *_ in got}
        assert {(p, i): (e, s) for p, i, e, s in got} == met
        assert all(v == (True, None) for k, v in told.items() if k not in met)
    assert scopes.resolve_overrides_table(frame, spark.createDataFrame([], OVERRIDES)).count() == 0
