"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Every benchmark window (13 consecutive words, or a shorter item's all) is a set that a document span must contain
whole, so a prefix of one token is enough: the window's rarest word over all documents. Word positions of the
documents are joined with these prefix tokens; a hit fixes the one span that can hold the window, which the position
and length bounds check, and the candidates are verified word by word at the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, row_key

#: Runs of these separate words; A-Z are lower-cased first.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What comes from the benchmark is broadcast up to so many bytes, and joined by shuffles beyond.
BROADCAST_BYTES = 8 << 20
#: A word with more than one in so many of all words is dealt over SALTS tasks in a shuffled join. There are at most as many such words.
HOT_SHARE, SALTS = 1000, 64


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK), "")


def item_windows(benchmark: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, win): the distinct windows of each item as space-joined words."""
    w = F.col("w")
    spans = F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - width + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(width)), " ")))
    spans = F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.coalesce(spans, F.array(F.array_join(w, " "))))
    return benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).select("item_id", F.explode(spans).alias("win")).distinct()


def sendable(df: DataFrame, *texts: str) -> bool:
    """Whether a written table may be broadcast: the bytes of its texts and 64 for each row, as counted."""
    size = df.agg(F.sum(sum((F.octet_length(c) for c in texts), F.lit(64)))).first()[0]
    return (size or 0) <= BROADCAST_BYTES


def salted(at: DataFrame, rare: DataFrame, n_words: int) -> DataFrame:
    """Words of documents (key, pos, word) joined with the windows' rare words, where frequent words are dealt over tasks.

    rare: with n, how often its word occurs in all documents. Words that are frequent by HOT_SHARE are so few that they
    are broadcast; their windows are copied to each salt, of which a document's word takes one.
    """
    hot = rare.where(F.col("n") * HOT_SHARE > n_words)
    salts = F.when(F.col("n") * HOT_SHARE > n_words, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = at.join(F.broadcast(hot.select("word", F.lit(True).alias("hot")).distinct()), "word", "left")
    left = left.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("key", "pos"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    return left.join(rare.withColumn("salt", F.explode(salts)), ["word", "salt"])


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = 13, share: tuple[int, int] = (1, 20), id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row for each row of `docs`: doc_id, key (`row_key`), n_words, n_hit, items (sorted strings), n_items, contaminated.

    A word is hit if it lies in an occurrence of a window; a document is contaminated if some word is hit and
    n_hit / n_words is at least `share`. Null and empty texts have no words and are clean, as is everything beside an
    empty benchmark. Items of null id count under the id "". Repeated rows get equal results; other columns don't matter.
    Texts may be of any length: their words are rows of a join, and a document's hits are one array.
    """
    items = cut(item_windows(benchmark, width, item_id_col, item_text_col))
    wins = items.select("win").distinct()
    tokens = wins.select("win", F.posexplode(F.split("win", " ")).alias("off", "word"))
    wanted = cut(tokens.select("word").distinct())

    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), words(F.col(text_col)).alias("w"))
    every = rows.select(F.explode("w").alias("word"))
    if sendable(wanted, "word"):
        seen = F.broadcast(cut(every.join(F.broadcast(wanted), "word").groupBy("word").agg(F.count("*").alias("n"))))
    else:
        seen = cut(every.groupBy("word").agg(F.count("*").alias("n")).join(wanted, "word", "left_semi"))
    rare = tokens.join(seen, "word", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "off")).alias("t"), F.count("*").alias("len"))
    rare = cut(rare.where("t.n > 0").select("win", "len", F.col("t.word").alias("word"), F.col("t.off").alias("off"), F.col("t.n").alias("n")))

    at = rows.select("key", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "word"))
    start = F.col("pos") - F.col("off")
    met = at.join(F.broadcast(rare), "word") if sendable(rare, "word", "win") else salted(at, rare, rows.agg(F.sum(F.size("w"))).first()[0])
    spans = met.where((start >= 0) & (start + F.col("len") <= F.col("n_words")))
    spans = spans.groupBy("key").agg(F.collect_set(F.struct(start.alias("start"), F.col("len").cast("int").alias("len"), "win")).alias("spans"))

    holds = F.filter(F.coalesce("spans", F.array()), lambda s: F.array_join(F.slice(F.col("w"), s["start"] + 1, s["len"]), " ") == s["win"])
    hit = F.array_distinct(F.flatten(F.transform("hits", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))))
    texts = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    found = texts.join(spans, "key", "left").select("doc_id", "key", words(F.col("text")).alias("w"), "spans")  # the texts are smaller than their words
    found = found.select("doc_id", "key", "w", holds.alias("hits"))
    found = cut(found.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), F.size(hit).cast("long").alias("n_hit"), F.array_distinct(F.col("hits.win")).alias("wins")))

    by_item = found.where(F.size("wins") > 0).select("key", F.explode("wins").alias("win")).join(items, "win")
    by_item = by_item.select("key", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")).groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = found.join(by_item, "key", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    dirty = (F.col("n_hit") > 0) & (F.col("n_hit") * share[1] >= F.col("n_words") * share[0])
    return out.select("doc_id", "key", "n_words", "n_hit", "items", F.size("items").cast("long").alias("n_items"), dirty.alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The clean rows of `docs`, columns unchanged, whatever their names.

    Rows of null or empty text are clean and stay, as do all rows beside an empty benchmark; rows that repeat id and text
    stay or go together; an empty table stays empty.
    """
    id_col, text_col = how.get("id_col", "doc_id"), how.get("text_col", "text")
    bad = find_contamination(docs, benchmark, **how).where("contaminated").select("key").distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row_key(id_col, text_col).alias("key"))
    return rows.join(bad, "key", "left_anti").select("row.*")
