"""Queries over the text tables, one for each operator, and their SQL where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, langid, lexical_search, license_passages, licenses, packing, periodic_runs, prefix_bpe, sharding, simhash, substring_dedup, tokencount, toxicity
from .common import in_bucket, text_bytes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), shards=16)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return rows.select("doc_id", (text_bytes() + 1).alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.fingerprints_under_edit(table(spark, sf_dir, "documents").select("doc_id", "text"))
    near = {f"near_{x}": fingerprints.likeness("fingerprint", f"{x}_fingerprint") for x in ("edited", "next")}
    return out.withColumns(near).select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", *near)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.identify_language(docs.select("doc_id", "text"), langid.train(docs))
    return out.select("doc_id", (in_bucket("doc_id", langid.HELD_OUT_PARTS) == langid.HELD_OUT).alias("held_out"), "lang_pred", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (in_bucket("doc_id", toxicity.HELD_OUT_PARTS) == 0).alias("held_out"), "score", "predicted")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", F.round("dice", 6).alias("dice"), "line", "n_passages")


def op8_license_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole licence texts and notices over any lines; no SQL."""
    found = license_passages.find_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", F.round("dice", 6).alias("dice"), "word", "n_words", "licenses")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", text_bytes().alias("n_bytes"), "n_tokens", "over_limit")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def periodic_words(doc_id: Column, w: Column) -> Column:
    """The words of a text; those of every tenth document, by the hash of its id, go on periodically from some word."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    begin = g % F.size(w)
    period = F.floor((F.size(w) - begin) / (g % 8 + 3)) + 1
    made = F.transform(w, lambda x, i: F.when(i >= begin, F.get(w, (begin + (i - begin) % period).cast("int"))).otherwise(x))
    return F.when((h % 10 == 0) & (F.size(w) > 0), made).otherwise(w)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic_runs.words(F.col("text")).alias("w"))
    docs = docs.select("doc_id", periodic_words(F.col("doc_id"), F.col("w")).alias("words"))
    found = periodic_runs.find_runs(docs, sequence=F.col("words"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("a"), (-r["start"]).alias("b"), (-r["period"]).alias("c"), r.alias("run"))))["run"]
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    told = found.select("doc_id", "runs", "kept", best.alias("best"), F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).alias("lines"))
    exponent = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return told.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exponent, F.sha2("lines", 256).alias("runs_sha256"), F.sha2(F.array_join("kept", " "), 256).alias("collapsed_sha256"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = prefix_bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN, decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search.search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_packing,
        op3_substring_dedup,
        op4_fingerprints,
        op5_simhash,
        op6_language_id,
        op7_toxicity,
        op8_license_scan,
        op8_license_passages,
        op9_token_counts,
        op10_decontamination,
        op11_periodic_runs,
        op12_byte_bpe,
        op13_lexical_search,
    )
}

#: Words of a document, windows of the items, spans of a document for each window length.
OP10_SQL = r"""
WITH items AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM items WHERE len(w) > 0)
), docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), spans AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, s.i, s.n, item_id FROM spans s JOIN wins USING (win, n)
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS items FROM hits GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""

#: Windows of 20 words, the place where each first starts, and the words that later ones cover.
OP3_SQL = r"""
WITH docs AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), wins AS (
  SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS win
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM docs WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM wins) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM later
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM docs
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

#: Distinct word bigrams of each line and of each template.
OP8_SQL = r"""
WITH templates AS (
  SELECT template, license, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS grams
  FROM (SELECT template, license, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM (VALUES %s) AS v(template, license, text))
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS passage, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line FROM documents
), grams AS (
  SELECT doc_id, line, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS grams
  FROM (SELECT doc_id, line, list_filter(string_split_regex(lower(passage), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM lines) WHERE len(w) > 0
), scored AS (
  SELECT doc_id, line, template, license, 2.0 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice FROM grams g, templates t
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, template, line) AS k, count(DISTINCT line) OVER (PARTITION BY doc_id) AS n FROM scored WHERE dice >= 0.8
)
SELECT doc_id, license, round(dice, 6) AS dice, line::BIGINT AS line, coalesce(n, 0)::BIGINT AS n_passages
FROM documents LEFT JOIN (SELECT * FROM ranked WHERE k = 1) USING (doc_id)
""" % ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(licenses.TEMPLATES))

#: Every term of every document with its share of the score, summed over the terms of each item.
OP13_SQL = r"""
WITH docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), items AS (
  SELECT item_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark
), sizes AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_words FROM docs WHERE len(w) > 0
), postings AS (
  SELECT doc_id, term, len(any_value(w))::BIGINT AS n, count(*)::BIGINT AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM items) GROUP BY doc_id, term
), weights AS (
  SELECT term, floor(1000 * ln((2.0 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM postings, sizes GROUP BY term
), shares AS (
  SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_words))) AS share FROM postings JOIN weights USING (term), sizes
), scores AS (
  SELECT item_id, doc_id, sum(share * repeats)::BIGINT AS score FROM (SELECT item_id, term, count(*) AS repeats FROM items GROUP BY item_id, term) JOIN shares USING (term) GROUP BY item_id, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""

ORACLES = {"op13_lexical_search": OP13_SQL, "op8_license_scan": OP8_SQL, "op3_substring_dedup": OP3_SQL, "op10_decontamination": OP10_SQL}
