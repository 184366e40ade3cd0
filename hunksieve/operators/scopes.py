"""Where rules hold, for globs and directory overrides that are rows of tables.

A glob is looked up by one key that all its paths have (see `patterns.glob_keys`), the one that the fewest paths hold, and
is tested in full only where the key is met. So the time hardly depends on how many globs there are. Globs without a key
are tested on every path, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lang import language_of
from ..functions.patterns import glob_keys, glob_regex, path_keys
from ..functions.text import depth, normal_path

#: Bytes of globs that are sent to all tasks at a time.
SENT = 8 << 20


@F.pandas_udf(T.StructType().add("java", "string").add("keys", T.ArrayType(T.StringType())))
def compiled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """A glob in Java's dialect, and its keys."""
    for globs in batches:
        yield pd.DataFrame([(glob_regex(g), glob_keys(g)) for g in globs], columns=["java", "keys"])


def glob_matches(paths: DataFrame, globs: DataFrame) -> DataFrame:
    """(path, glob): each distinct path with each distinct glob that matches it. Nulls match nothing.

    A glob that can't be used stops the job.
    """
    every = paths.where("path is not null").select("path").distinct()
    known = globs.where("glob is not null").select("glob").distinct().select("glob", compiled("glob").alias("c")).select("glob", "c.*")
    keyed = every.select("path", F.explode(path_keys(F.col("path"))).alias("key"))

    none, bytes_ = F.size("keys") == 0, F.octet_length("java") + F.octet_length("glob") + 64
    size, broad_size = known.agg(F.coalesce(F.sum(bytes_), F.lit(0)), F.coalesce(F.sum(F.when(none, bytes_)), F.lit(0))).first()

    wanted = known.select("glob", F.explode("keys").alias("key"))
    counts = keyed.join(wanted.select("key").distinct(), "key").groupBy("key").agg(F.count("*").alias("n"))
    # A key without paths has no count: its glob matches none.
    rarest = wanted.join(counts, "key", "left").groupBy("glob").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("least"))
    index = known.join(rarest.where("least.n > 0"), "glob").select("glob", "java", F.col("least.key").alias("key"))
    met = keyed.join(F.broadcast(index) if size <= SENT else index, "key")
    out = met.where(F.rlike(F.col("path"), F.col("java"))).select("path", "glob")

    blocks = broad_size // SENT + 1 if broad_size else 0
    for b in range(blocks):
        own = known.where(none).where(F.pmod(F.xxhash64("glob"), F.lit(blocks)) == b)
        pack = own.agg(F.collect_list(F.struct("glob", "java")).alias("p")).scalar()
        tested = every.select("path", pack.alias("pack"))
        out = out.unionByName(tested.select("path", F.inline(F.filter("pack", lambda p: F.rlike(F.col("path"), p["java"])))).select("path", "glob"))
    return out


def listed(rules: DataFrame, name: str) -> Column:
    """A rule's list of that name; empty if it's null or the table has none."""
    return F.coalesce(F.col(name), F.array().cast("array<string>")) if name in rules.columns else F.array().cast("array<string>")


def applicable_table(paths: DataFrame, rules: DataFrame, language: str | None = None) -> DataFrame:
    """(path, rule_id, severity): where the rules of a table hold. rules: id, severity, and perhaps paths, exclude_paths, languages.

    Null or empty lists ask for nothing; a rule holds where one of its paths matches, none of its exclude_paths does, and
    the file has one of its languages. Ids are unique.
    """
    told = rules.select(F.col("id").alias("rule_id"), "severity", *(listed(rules, c).alias(c) for c in ("paths", "exclude_paths", "languages")))
    include = told.select("rule_id", F.explode(F.when(F.size("paths") > 0, F.col("paths")).otherwise(F.array(F.lit("**")))).alias("glob"))
    exclude = told.select("rule_id", F.explode("exclude_paths").alias("glob"))
    inside = glob_matches(paths, include).join(include, "glob").select("path", "rule_id").distinct()
    outside = glob_matches(paths, exclude).join(exclude, "glob").select("path", "rule_id")
    lang = F.lit(language.lower()) if language else language_of(F.col("path"))
    spoken = (F.size("languages") == 0) | F.coalesce(F.array_contains(F.transform("languages", F.lower), lang), F.lit(False))
    out = inside.join(outside, ["path", "rule_id"], "left_anti").join(told.select("rule_id", "severity", "languages"), "rule_id")
    return out.where(spoken).select("path", "rule_id", "severity")


def resolve_overrides_table(paths: DataFrame, overrides: DataFrame) -> DataFrame:
    """(path, rule_id, enabled, severity) for all paths and the rules that are overridden in some folder above.

    overrides: seq, directory, rule_id, enabled, severity, and perhaps exclude_paths, an array. What comes last counts:
    the deepest folder, then the folder's name, then seq; inside one override its globs come after `enabled`. Each path
    meets its own folders by equality, one row for each folder and rule, and the globs by their keys.
    """
    folder = F.regexp_replace(normal_path(F.col("directory")), r"/+\z", "")
    specs = overrides.select("seq", F.when(folder == ".", "").otherwise(folder).alias("directory"), "rule_id", "enabled", F.nullif("severity", F.lit("")).alias("severity"), listed(overrides, "exclude_paths").alias("globs")).withColumn("depth", depth(F.col("directory")))
    said = lambda c: F.max_by(F.struct(c, "seq"), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    last = specs.groupBy("rule_id", "directory", "depth").agg(said("enabled"), said("severity"))
    files = paths.select("path").distinct().withColumn("at", normal_path(F.col("path")))
    parts = F.split("at", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    place = lambda c, seq, after: F.when(F.col(c).isNotNull(), F.struct("depth", "directory", F.col(seq).alias("seq"), F.lit(after).alias("after")))
    rows = files.select("path", F.explode(F.array_distinct(above)).alias("directory")).join(last, "directory")
    rows = rows.select("path", "rule_id", F.col("enabled.enabled").alias("enabled"), place("enabled.enabled", "enabled.seq", 0).alias("enabled_at"), F.col("severity.severity").alias("severity"), place("severity.severity", "severity.seq", 0).alias("severity_at"))

    g = F.regexp_replace(F.replace("g", F.lit("\\"), F.lit("/")), r"\A\./", "")
    glob = F.when((F.col("directory") == "") | F.startswith(g, F.lit("/")), F.regexp_replace(g, r"\A/+", "")).otherwise(F.concat("directory", F.lit("/"), g))
    globs = specs.select("seq", "directory", "depth", "rule_id", F.explode("globs").alias("g")).withColumn("glob", glob).drop("g")
    met = glob_matches(files.select(F.col("at").alias("path")), globs).withColumnRenamed("path", "at")
    # Of the overrides that a glob stands in for a rule the last counts; a file may lie outside its folder if the glob begins at the root.
    found = met.join(globs, "glob").where((F.col("directory") == "") | (F.col("at") == F.col("directory")) | F.startswith("at", F.concat("directory", F.lit("/"))))
    found = found.withColumn("enabled", F.lit(False)).join(files, "at").select("path", "rule_id", "enabled", place("enabled", "seq", 1).alias("enabled_at"), F.lit(None).cast("string").alias("severity"), F.lit(None).cast(rows.schema["severity_at"].dataType).alias("severity_at"))
    out = rows.unionByName(found).groupBy("path", "rule_id")
    return out.agg(F.coalesce(F.max_by("enabled", "enabled_at"), F.lit(True)).alias("enabled"), F.max_by("severity", "severity_at").alias("severity"))


def in_scope(events: DataFrame, rules: DataFrame, language: str | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """The events of rules in a table that hold where they were found, with the severity that overrides give there.

    Only paths with an event of a rule meet the rule's globs.
    """
    plain = rules.select(F.col("id").alias("rule_id"), *(listed(rules, c).alias(c) for c in ("paths", "exclude_paths", "languages")))
    some = plain.where((F.size("paths") > 0) | (F.size("exclude_paths") > 0) | (F.size("languages") > 0))
    each = lambda c: some.select("rule_id", F.explode(c).alias("glob")).select("rule_id", compiled("glob")["java"].alias("java")).groupBy("rule_id").agg(F.collect_list("java").alias(c))
    asked = some.select("rule_id", "languages").join(each("paths"), "rule_id", "left").join(each("exclude_paths"), "rule_id", "left")
    met = lambda c: F.exists(c, lambda g: F.rlike(F.col("path"), g))
    lang = F.lit(language.lower()) if language else language_of(F.col("path"))
    holds = F.coalesce(met("paths"), F.lit(True)) & ~F.coalesce(met("exclude_paths"), F.lit(False))
    holds = holds & ((F.size("languages") == 0) | F.coalesce(F.array_contains(F.transform("languages", F.lower), lang), F.lit(False)))
    off = events.select("path", "rule_id").distinct().join(asked, "rule_id").where(~holds).select("path", "rule_id")
    kept = events.join(off, ["path", "rule_id"], "left_anti")
    if overrides is not None:
        told = resolve_overrides_table(events, overrides).withColumnRenamed("severity", "_severity")
        kept = kept.join(told, ["path", "rule_id"], "left").where(F.coalesce("enabled", F.lit(True))).withColumn("severity", F.coalesce("_severity", "severity"))
    return kept.select(*events.columns)
