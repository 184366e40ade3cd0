"""Records against their JSON Schemas: each error a row with its place, over any number of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a value of a schema's type is called in a variant; numbers without a fraction are integers.
KINDS = {"object": "OBJECT<", "array": "ARRAY<", "string": "STRING", "boolean": "BOOLEAN", "integer": r"(BIGINT|DECIMAL\(\d+,0\))", "null": "VOID"}
ERRORS = "array<struct<at: string, error: string>>"


def bound(value: Column, said) -> Column:
    """`said` of a value that is worked out once, however often `said` names it."""
    return F.get(F.transform(F.array(value), said), F.lit(0))


def errors_of(value: Column, schema: dict, at: Column) -> Column:
    """ERRORS of a variant: types, required properties, enum, const and minimum, in the depth of properties and items."""
    return bound(F.coalesce(F.schema_of_variant(value), F.lit("VOID")), lambda kind: errors_of_kind(value, kind, schema, at))


def errors_of_kind(value: Column, kind: Column, schema: dict, at: Column) -> Column:
    none = F.array().cast(ERRORS)
    said = lambda bad, text: F.when(F.coalesce(bad, F.lit(False)), F.array(F.struct(at.alias("at"), F.lit(text).alias("error"))))
    types = [schema["type"]] if isinstance(schema.get("type"), str) else schema.get("type", [])
    fits = F.rlike(kind, F.lit("^(" + "|".join(KINDS[t] for t in types) + ")")) if types else F.lit(True)
    out = [said(~fits, f"is no {' or '.join(types)}")]
    allowed = [schema["const"]] if "const" in schema else schema.get("enum")
    if allowed:
        out.append(said(fits & ~F.try_variant_get(value, "$", "string").isin(*allowed), f"is none of {', '.join(allowed)}"))
    if "minimum" in schema:
        out.append(said(F.try_variant_get(value, "$", "decimal(38,0)") < schema["minimum"], f"is less than {schema['minimum']}"))
    is_object = F.startswith(kind, F.lit("OBJECT<"))
    for name, own in schema.get("properties", {}).items():
        needed = is_object & F.lit(name in schema.get("required", ()))
        out.append(bound(F.try_variant_get(value, f"$.{name}", "variant"), property_errors(own, F.concat(at, F.lit(f".{name}")), needed)))
    if "items" in schema:
        items = F.try_variant_get(value, "$", "array<variant>")
        out.append(F.flatten(F.transform(items, lambda x, i: errors_of(x, schema["items"], F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))))
    return F.concat(*(F.coalesce(x.cast(ERRORS), none) for x in out))


def property_errors(schema: dict, place: Column, needed: Column):
    """What gives the ERRORS of a property, null where it isn't there; it may have to be."""
    missing = F.array(F.struct(place.alias("at"), F.lit("is missing").alias("error"))).cast(ERRORS)
    return lambda child: F.when(child.isNotNull(), errors_of(child, schema, place)).when(needed, missing)


def record_errors(records: DataFrame, schema: dict) -> DataFrame:
    """The errors of records (a column `text`, and any others, which stay): at, a place such as `$.runs[2].status`, and error.

    A text that is null or no JSON has one error at `$`. Properties that the schema doesn't name are no errors.
    """
    others = [c for c in records.columns if c != "text"]
    parsed = records.select(*(F.col(f"`{c}`") for c in others), F.try_parse_json("text").alias("_v"))
    broken = F.array(F.struct(F.lit("$").alias("at"), F.lit("is no JSON").alias("error"))).cast(ERRORS)
    told = F.when(F.col("_v").isNull(), broken).otherwise(errors_of(F.col("_v"), schema, F.lit("$")))
    return parsed.select(*(F.col(f"`{c}`") for c in others), F.inline(told))


def file_errors(spark: SparkSession, path: str, schema: dict) -> DataFrame:
    """(file, at, error) for the records at `path`, each a file of its own."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return record_errors(texts, schema)
