"""Licence scans: passages of a text against licence templates by the Dice coefficient of their word bigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key

#: Public licence notices, as they stand in source files and READMEs.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring words; words are runs of ASCII letters and digits, lower-cased; a lone word is paired with nothing."""
    words = F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(F.size(words) > 1, F.slice(pairs, 1, F.size(words) - 1)).otherwise(words))


def templates(spark: SparkSession, rows: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(template, license, grams, size): as many rows as the list has."""
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "template int, license string, text string")
    return frame.select("template", "license", bigrams(F.col("text")).alias("grams")).withColumn("size", F.size("grams")).where("size > 0")


def scan_licenses(docs: DataFrame, rows: list[tuple[str, str]] = TEMPLATES, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs` (repeated rows get equal results): doc_id, key, license and dice of the best passage, its line (from 0), n_passages.

    Passages are lines. A line meets a template only where its size allows `least`: between size * least / (2 - least)
    and its inverse. Of equal coefficients the smaller template number, then the earlier line wins; without a match
    license, dice and line are null and n_passages is 0. Null and empty texts match nothing.
    """
    known = templates(docs.sparkSession, rows)
    ratio = least / (2 - least)
    sizes = sorted({r["size"] for r in known.select("size").collect()})
    lines = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text")).select("doc_id", "key", F.posexplode(F.split("text", "\n")).alias("line", "passage"))
    fits = F.lit(False)
    for n in sizes:
        fits = fits | F.size("grams").between(n * ratio, n / ratio)
    held = lines.select("doc_id", "key", "line", bigrams(F.col("passage")).alias("grams")).where(fits).select("doc_id", "key", "line", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    grams = known.select("template", "license", "size", F.explode("grams").alias("gram"))
    met = held.join(F.broadcast(grams), "gram").where((F.col("n") >= F.col("size") * ratio) & (F.col("n") <= F.col("size") / ratio))
    scored = met.groupBy("doc_id", "key", "line", "template", "license", "n", "size").agg(F.count("*").alias("shared")).withColumn("dice", 2.0 * F.col("shared") / (F.col("n") + F.col("size"))).where(F.col("dice") >= least)
    best = scored.groupBy("key").agg(F.min(F.struct((-F.col("dice")).alias("less"), "template", "line", "license")).alias("best"), F.count_distinct("line").alias("n_passages"))
    all_rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"))
    out = all_rows.join(best, "key", "left")
    return out.select("doc_id", "key", F.col("best.license").alias("license"), (-F.col("best.less")).alias("dice"), F.col("best.line").cast("long").alias("line"), F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"))
