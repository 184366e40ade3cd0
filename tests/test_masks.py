"""Masks of runs in blocks: maps of what is open, and whole tables against a reading character by character."""

import random
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest

from hunksieve.functions import masking
from hunksieve.operators import evaluate
from hunksieve.queries import QUERIES
from hunksieve.tables import EXTENSIONS

SF_DIR = "/root/testdata/sf0.001"
LANGS = ["rust", "python", "javascript", "go", "shell", "swift", "sql", "xml", "php", "c", "scala", "yaml"]
PIECES = ['"', "'", "`", "/*", "*/", "//", "#", "--", "<!--", "-->", '"""', "'''", 'r#"', 'r"', '"#', "##", '"##', 'br##"', "\\", "\\\\", "$'", "a", "b c", " ", "", "x", "\n", "\n", "\n"]


def random_text(rng, n):
    return "".join(rng.choice(PIECES) for _ in range(n))


def test_exits():
    """From every state that may be open: the map of a text, and that of two, against scanning on."""
    rng = random.Random(5)
    for _ in range(700):
        lang, lines = rng.choice(LANGS), random_text(rng, rng.choice([3, 10, 40])).split("\n")
        for comments in (True, False):
            text = "\n".join(lines)
            states, found = masking.starts(lang, comments, 4, 6), masking.exits(text, lang, comments)
            for s in states:
                assert masking.leave(found, s) == masking.scan(text, lang, comments, s)[1], (lang, text, s)
            for cut in range(1, len(lines)):
                first, second = (masking.exits("\n".join(x), lang, comments) for x in (lines[:cut], lines[cut:]))
                both = masking.follow(first, second, lang, comments)
                for s in states:
                    assert masking.leave(both, s) == masking.leave(second, masking.leave(first, s)), (lang, lines, cut, s)


def masked_rows(df):
    return Counter((r.diff_id, r.idx, r.no_comments, r.no_strings, r.no_both, r.suppress_all, tuple(r.suppress_ids)) for r in df.collect())


def test_blocks(spark, monkeypatch):
    """The same rows however long the blocks are, down to one line, with directives at their ends and tangled files."""
    rng, rows = random.Random(6), []
    say = ["// hunksieve: ignore-next-line\n", "# hunksieve: ignore-next-line a, b\n", "/* hunksieve: ignore x */\n"]
    for f, ext in enumerate(["rs", "py", "js", "sql", "go", "swift", "html", "c"] * 3):
        text = "".join(random_text(rng, 6) + rng.choice(["\n", *say]) for _ in range(12))
        for n, content in enumerate(text.split("\n")):
            rows.append((f"d{f % 2}", (n * 40 + f if f % 3 == 0 else f * 1000 + n) * 2, f"f{f}.{ext}", n + 1, content, "added"))
    lines = spark.createDataFrame(rows, "diff_id string, idx long, path string, line long, content string, kind string")
    want = masked_rows(evaluate.masked(lines))
    told = Counter(map(tuple, evaluate.suppressions(lines).select("diff_id", "at", "suppress_all").collect()))
    assert told and set(told) == {(d, i, every) for d, i, *_, every, ids in want if every or ids}
    for bits in (3, 0):
        monkeypatch.setattr(evaluate, "BLOCK_BITS", bits)
        monkeypatch.setattr(evaluate, "RANGE_BITS", bits)
        assert masked_rows(evaluate.masked(lines)) == want
    assert Counter(map(tuple, evaluate.suppressions(lines).select("diff_id", "at", "suppress_all").collect())) == told


@pytest.mark.parametrize("bits", [30, 5, 0])
def test_tangled_files(spark, bits, monkeypatch):
    monkeypatch.setattr(evaluate, "RANGE_BITS", bits)
    monkeypatch.setattr(evaluate, "BLOCK_BITS", bits)
    rng, rows = random.Random(bits), []
    for d in "abc":
        at = 0
        for _ in range(40):
            path = f"p{rng.randrange(25)}"
            for _ in range(rng.randrange(1, 4)):
                at += rng.choice([1, 1, 9])
                rows.append((d, at, path, at, "", "added"))
    lines = spark.createDataFrame(rows, "diff_id string, idx long, path string, line long, content string, kind string")
    spans, runs, number, last = defaultdict(list), {}, 0, None
    for d, at, path, *_ in rows:
        spans[d, path].append(at)
        number = 0 if last is None or last[0] != d else number + (last[1] != path)
        runs[d, at], last = number, (d, path)
    tangled = {k for k, at in spans.items() if any(x[0] == k[0] and x[2] != k[1] and at[0] < x[1] < at[-1] for x in rows)}
    found = evaluate.file_table(lines).collect()
    # A file around which another lies counts as tangled with it.
    assert {(r.diff_id, r.path) for r in found if r.tangled} >= tangled and len(found) == len(spans)
    told = defaultdict(set)
    for r in evaluate.with_runs(lines).collect():
        told[r.diff_id, r.path, r.run].add(runs[r.diff_id, r.idx])
    assert sum(len(x) for x in told.values()) == len(told) == len({(d, p, runs[d, at]) for d, at, p, *_ in rows})


HASH, SLASH = ["#"], ["//", "/*"]
QUOTES = {"python": ['"""', "'''", '"', "'"], "javascript": ["`", '"', "'"], "go": ["`", '"'], "shell": ["$'", "'", '"'], "sql": ["'"], "rust": ["raw", 'b"', '"', "'"]}
MARKS = {"python": HASH, "shell": HASH, "sql": ["--", "/*"], "xml": ["<!--"]}


def read(text, lang, comments):
    """What each character is: code, a comment or a string."""
    out, i, n = [" "] * len(text), 0, len(text)
    while i < n:
        quote = next((q for q in QUOTES.get(lang, ['"', "'"]) if q != "raw" and text.startswith(q, i)), None)
        if lang == "rust":
            at = i + text.startswith("br", i) + 1
            k = at
            while text[i:at] in ("r", "br") and k < n and text[k] == "#":
                k += 1
            if text[i:at] in ("r", "br") and k < n and text[k] == '"':
                end = text.find('"' + "#" * (k - at), k + 1)
                end = n if end < 0 else end + 1 + k - at
                out[i:end] = "s" * (end - i)
                i = end
                continue
        mark = next((m for m in MARKS.get(lang, SLASH) if text.startswith(m, i)), None) if comments and not quote else None
        if quote:
            close, k = quote.lstrip("$b"), i + len(quote)
            plain = (lang == "go" and quote == "`") or (lang == "shell" and quote == "'")
            while k < n and not text.startswith(close, k):
                if text[k] == "\\" and not plain:
                    k += 1
                    while k < n and text[k] == "\n":
                        k += 1
                k += 1
            end = min(n, k + len(close))
            out[i:end] = "s" * (end - i)
        elif mark in ("/*", "<!--"):
            close, depth, k = ("-->" if mark == "<!--" else "*/"), 1, i + len(mark)
            while k < n and depth:
                if text.startswith(close, k):
                    depth, k = depth - 1, k + len(close)
                elif lang == "rust" and text.startswith("/*", k):
                    depth, k = depth + 1, k + 2
                else:
                    k += 1
            end = k
            out[i:end] = "c" * (end - i)
        elif mark:
            end = text.find("\n", i)
            end = n if end < 0 else end
            out[i:end] = "c" * (end - i)
        else:
            end = i + 1
        i = end
    return out


def blanked(text, lang):
    """Lines without comments, without strings, without both."""
    full, alone = read(text, lang, True), read(text, lang, False)
    keep = lambda kinds, gone: "".join(c if c == "\n" or k not in gone else " " for c, k in zip(text, kinds, strict=True)).split("\n")
    return list(zip(keep(full, "c"), keep(alone, "s"), keep(full, "sc"), strict=True))


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")
def test_true_texts(spark):
    """mask_true_texts and mask_html_blocks over their whole tables, whose texts stand as they are."""
    langs = {"rs": "rust", "py": "python", "js": "javascript", "sql": "sql", "go": "go", "sh": "shell", "html": "xml", "txt": "c"}
    want = Counter()
    for d, source, lang, text in duckdb.sql(f"SELECT doc_id, source, lang, text FROM '{SF_DIR}/documents.parquet'").fetchall():
        ext = EXTENSIONS[d % 8]
        want.update((f"{source}/{lang}/doc_{d}.{ext}", n, *x) for n, x in enumerate(blanked(text, langs[ext]), 1))
    rows = QUERIES["mask_true_texts"](spark, SF_DIR).collect()
    assert Counter((r.path, r.line, r.no_comments, r.no_strings, r.no_both) for r in rows) == want
    want = Counter()
    for p, html in duckdb.sql(f"SELECT page_id, html FROM '{SF_DIR}/pages.parquet'").fetchall():
        want.update((f"{p}.html", n, x[0]) for n, x in enumerate(blanked(html, "xml"), 1))
    assert Counter((r.path, r.line, r.no_comments) for r in QUERIES["mask_html_blocks"](spark, SF_DIR).collect()) == want


def test_reading():
    rng = random.Random(8)
    for _ in range(1500):
        lang, text = rng.choice(["rust", "python", "javascript", "sql", "go", "shell", "xml", "c"]), random_text(rng, 30)
        assert masking.mask_lines(text.split("\n"), lang) == blanked(text, lang), (lang, text)


@pytest.mark.parametrize("size", (1, 5, 40))
def test_batches_are_scanned_in_slices(monkeypatch, size):
    lines = ['a /* b "c', None, 'd */ "e', "", 'f" // hunksieve: ignore-next-line', "g 'h' /* /* i", "j */ k */ l"] * 4
    n = len(lines)
    columns = {"diff_id": ["d"] * n, "path": ["p.rs"] * n, "run": [0] * n, "block": [0] * n, "lang": ["rust"] * n, "begin": pa.array([None] * n, pa.string()), "idx": list(range(n)), "content": lines}
    batch = pa.RecordBatch.from_pydict(columns)
    whole = [r for b in masking.mask_stream(True)(iter([batch])) for r in b.to_pylist()]
    told = [b.to_pylist() for b in masking.mask_maps(True)(iter([batch.drop_columns(["begin"])]))]
    monkeypatch.setattr(masking, "SLICE", size)
    made = list(masking.mask_stream(True)(iter([batch])))
    assert len(made) > 3 and all(sum(map(len, filter(None, b.column("content").to_pylist()))) < size + 34 for b in made)
    assert [r for b in made for r in b.to_pylist()] == whole
    parted = [b.to_pylist() for b in masking.mask_maps(True)(iter([batch.drop_columns(["begin"])]))]
    assert list(masking.mask_begins(iter([pa.RecordBatch.from_pylist(told[0] * 2)])))[0].to_pylist() == list(masking.mask_begins(iter([pa.RecordBatch.from_pylist(parted[0] * 2)])))[0].to_pylist()
