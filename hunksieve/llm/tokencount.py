"""Token counts by rank-synchronous array merging (see `bpe`)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import in_chunks, merger

#: Distinct pre-tokens a worker remembers before it starts anew, and the bytes merged at a time.
REMEMBERED, CHUNK = 400_000, 1 << 20


def counter(path: str):
    """Pandas UDF: tokens of each text."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, known = merger(path), {}
        for texts in batches:
            if len(known) > REMEMBERED:
                known.clear()
            out = []
            for lo in range(0, len(texts), 256):
                split = [m.split(t or "") for t in texts.iloc[lo : lo + 256]]
                new = list({t for tokens, _ in split for t in tokens} - known.keys())
                for some in in_chunks(new, CHUNK):
                    known.update(zip(some, m.counts([t if isinstance(t, bytes) else t.encode() for t in some]).tolist(), strict=True))
                get = known.__getitem__
                out += [sum(map(get, tokens)) + special for tokens, special in split]
            yield pd.Series(out, dtype="int64")

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text_col: str = "text") -> DataFrame:
    """`docs` with n_tokens (as the library counts them, no special tokens added) and over_limit (n_tokens > limit).

    Null and empty texts have none; special strings inside a text count as one token each. One pass, no shuffle.
    Columns of those names are replaced.
    """
    out = docs.withColumn("n_tokens", counter(path)(F.coalesce(F.col(text_col), F.lit(""))))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
