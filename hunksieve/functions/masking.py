"""Comments and strings of source lines as blanks, and the directives in the comments.

A language is a table of openers, each with the pattern that ends what it opens. The text of a run of lines is scanned
from opener to opener, so state is carried over line ends; line comments end with their line. A blank stands for each
code point.

A long run is scanned in blocks, side by side. What a block does to what is open is a map: it is scanned from each state
that may be open before it, until the scan falls in with one that was done before. Maps of neighbouring blocks compose.
Nested comments and raw strings have any number of states; those beyond what a block can close all pass through it.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..constants import DIRECTIVE
from .lang import COMMENTS, STRINGS


def _quoted(quote: str, times: int = 1) -> str:
    """The rest of a string with backslash escapes; an escape at the end of a line is for the next line's first character."""
    return rf"(?:\\\n*[^\n]|[^\\])*?{re.escape(quote) * times}"


STRING_OPENERS = {
    "rust": [("(?:b?r)(?P<hashes>#*)\"", None), ('b"', _quoted('"')), ('"', _quoted('"')), ("'", _quoted("'"))],
    "python": [('"""', _quoted('"', 3)), ("'''", _quoted("'", 3)), ('"', _quoted('"')), ("'", _quoted("'"))],
    "script": [("`", _quoted("`")), ('"', _quoted('"')), ("'", _quoted("'"))],
    "go": [("`", "[^`]*`"), ('"', _quoted('"'))],
    "shell": [(r"\$'", _quoted("'")), ("'", "[^']*'"), ('"', _quoted('"'))],
    "swift": [('"""', _quoted('"', 3)), ('"', _quoted('"'))],
    "sql": [("'", _quoted("'"))],
    "xml": [('"', _quoted('"')), ("'", _quoted("'"))],
    "php": [('"', _quoted('"')), ("'", _quoted("'"))],
    "c": [('"', _quoted('"')), ("'", _quoted("'"))],
}
LINE_END, BLOCK = r"[^\n]*", r"(?s:.*?)\*/"
COMMENT_OPENERS = {
    "hash": [("#", LINE_END)],
    "php": [("#", LINE_END), ("//", LINE_END), (r"/\*", BLOCK)],
    "sql": [("--", LINE_END), (r"/\*", BLOCK)],
    "xml": [("<!--", "(?s:.*?)-->")],
    "nested": [("//", LINE_END), (r"/\*", "nested")],
    "c": [("//", LINE_END), (r"/\*", BLOCK)],
}
NEST = re.compile(r"/\*|\*/")


@lru_cache(maxsize=64)
def _table(lang: str, comments: bool) -> tuple[re.Pattern, re.Pattern, list[tuple[bool, str | re.Pattern | None]]]:
    """What an opener begins with, one pattern of all openers, in order, and for each whether it opens a comment and what ends it."""
    rows = [(False, *x) for x in STRING_OPENERS[STRINGS.get(lang, "c")]]
    rows += [(True, *x) for x in COMMENT_OPENERS[COMMENTS.get(lang, "c")]] if comments else []
    opener = re.compile("|".join(f"(?P<k{i}>{pattern})" for i, (_, pattern, _) in enumerate(rows)))
    first = "".join(sorted({c for *_, pattern, _ in rows for c in ("br" if pattern.startswith("(?:b?r)") else pattern.lstrip("\\")[0])}))
    return re.compile(f"[{re.escape(first)}]"), opener, [(is_comment, end if end in (None, "nested") else re.compile(end)) for is_comment, _, end in rows]


#: An escape that waits for its character, and what is left of a string that ends in one.
LATE, DANGLING = re.compile(r"\n*[^\n]"), re.compile(r"(?:\\\n*[^\n]|[^\\])*(\\\n*)?")
State = tuple[int, object] | None


def _close(text: str, at: int, end, more) -> tuple[int, object]:
    """Where that ends which is open at `at` (-1: not in this text), and what goes on after the text: closer, depth or escape."""
    if end is None:
        close = text.find(more, at)
        return (-1, more) if close < 0 else (close + len(more), None)
    if end == "nested":
        while more and (n := NEST.search(text, at)):
            more, at = more + (1 if n[0] == "/*" else -1), n.end()
        return (-1, more) if more else (at, None)
    if more:
        late = LATE.match(text, at)
        if not late:
            return -1, True
        at = late.end()
    if close := end.match(text, at):
        return close.end(), None
    return -1, end.pattern.startswith("(?:") and DANGLING.fullmatch(text, at)[1] is not None


def _next(first: re.Pattern, opener: re.Pattern, text: str, at: int) -> re.Match | None:
    """The next opener. Characters that none begins with are skipped at the speed of a plain search."""
    while f := first.search(text, at):
        if m := opener.match(text, f.start()):
            return m
        at = f.start() + 1
    return None


def scan(text: str, lang: str, comments: bool, state: State = None) -> tuple[list[tuple[bool, int, int]], State]:
    """(is a comment, start, end) of strings and, if asked for, comments, and what is open at the end of the text.

    `state` is what was open before; a text goes on from the line after.
    """
    first, opener, rows = _table(lang, comments)
    found, at = [], 0
    if state is not None:
        row, more = state
        at, more = _close(text, 0, rows[row][1], more)
        found.append((rows[row][0], 0, len(text) if at < 0 else at))
        if at < 0:
            return found, (row, more)
    while m := _next(first, opener, text, at):
        row = int(m.lastgroup[1:])
        is_comment, end = rows[row]
        at, more = _close(text, m.end(), end, '"' + m["hashes"] if end is None else int(end == "nested"))
        found.append((is_comment, m.start(), len(text) if at < 0 else at))
        if at < 0:
            return found, (row, more)
    return found, None


def blank(text: str, cuts: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for start, end in cuts:
        piece = text[start:end]
        out += [text[at:start], " " * len(piece) if "\n" not in piece else re.sub(r"[^\n]", " ", piece)]
        at = end
    return "".join([*out, text[at:]])


def mask_some(lines: list[str], lang: str, states: tuple[State, State] = (None, None), strings: bool = True) -> tuple[list[list[str]], tuple[State, State]]:
    """Lines without comments, without strings, without both, and what is open after the last: with and without comments.

    Strings are looked for a second time, as if there were no comments, only if `strings` are asked for.
    """
    text = "\n".join(lines)
    full, open_full = scan(text, lang, True, states[0])
    alone, open_strings = scan(text, lang, False, states[1]) if strings else ([], None)
    cuts = [(a, b) for c, a, b in full if c], [(a, b) for _, a, b in alone], [(a, b) for _, a, b in full]
    return [blank(text, x).split("\n") if x else lines for x in cuts], (open_full, open_strings)


def mask_lines(lines: list[str], lang: str) -> list[tuple[str, str, str]]:
    """Of each line of a run: without comments, without strings, without both."""
    return list(zip(*mask_some(lines, lang)[0], strict=True))


Exits = dict[State, State]


def starts(lang: str, comments: bool, hashes: int, depth: int) -> list[State]:
    """All states that may be open before a text, with raw strings of up to so many hashes and comments nested so deep."""
    out: list[State] = [None]
    for row, (_, end) in enumerate(_table(lang, comments)[2]):
        if end is None:
            out += [(row, '"' + "#" * k) for k in range(hashes + 1)]
        elif end == "nested":
            out += [(row, k) for k in range(1, depth + 1)]
        elif end.pattern != LINE_END:
            out += [(row, more) for more in ((False, True) if end.pattern.startswith("(?:") else (False,))]
    return out


def beyond(exits: Exits) -> tuple[int, int]:
    """The most hashes, and the depth, that the states of a map have; of what has more, a map says what it says of these."""
    own = [more for _, more in filter(None, exits)]
    return max((len(x) - 1 for x in own if isinstance(x, str)), default=0), max((x for x in own if not isinstance(x, bool | str)), default=0)


def leave(exits: Exits, state: State) -> State:
    """What is open after a text, if `state` is before it."""
    if state in exits:
        return exits[state]
    row, more = state
    if isinstance(more, str):
        return state
    deepest = beyond(exits)[1]
    return row, exits[row, deepest][1] + more - deepest


def follow(first: Exits, second: Exits, lang: str, comments: bool) -> Exits:
    """The map of two texts one after the other."""
    (h1, d1), (h2, d2) = beyond(first), beyond(second)
    deep = next((out[1] for (_, more), out in ((s, o) for s, o in first.items() if s) if more is d1 and d1 and out), 0)
    return {s: leave(second, leave(first, s)) for s in starts(lang, comments, max(h1, h2), max(d1, d1 + d2 - deep) if d1 else 0)}


def exits(text: str, lang: str, comments: bool) -> Exits:
    """The map of a text."""
    first, opener, rows = _table(lang, comments)
    plain, end = scan(text, lang, comments)
    begins, ends = [a for _, a, _ in plain], [b for *_, b in plain]
    if end is not None:
        ends[-1] = len(text) + 1
    hashes = max((len(x) for x in re.findall('"(#*)', text)), default=-1) + 1
    level = lowest = 0
    for m in NEST.finditer(text):
        level += 1 if m[0] == "/*" else -1
        lowest = min(lowest, level)
    known: dict[int, State] = {}
    out: Exits = {None: end}
    for state in starts(lang, comments, hashes, 1 - lowest):
        if state is None:
            continue
        row, more = state
        at, more = _close(text, 0, rows[row][1], more)
        met, found = [], (row, more) if at < 0 else None
        while at >= 0:
            k = bisect_left(begins, at) - 1  # the last that begins before
            if k < 0 or ends[k] <= at:  # nothing is open here in the first scan either
                found = end
                break
            if at in known:
                found = known[at]
                break
            met.append(at)
            m = _next(first, opener, text, at)
            if not m:
                found = None
                break
            row = int(m.lastgroup[1:])
            close = rows[row][1]
            at, more = _close(text, m.end(), close, '"' + m["hashes"] if close is None else int(close == "nested"))
            found = (row, more)
        known.update(dict.fromkeys(met, found))
        out[state] = found
    return out


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def directive(line: str, masked: str | None) -> tuple[str, bool, list[str]] | None:
    """(same or next, all rules, rule ids) of the first valid directive of a line, whose prefix must lie in a comment."""
    low = lower_ascii(line)
    at = low.find(DIRECTIVE)
    while at >= 0:
        end = at + len(DIRECTIVE)
        if masked is None or not masked[at:end].strip(" "):
            rest = line[end:].lstrip()
            for word, kind in (("ignore-next-line", "next"), ("ignore-all", "same"), ("ignore", "same")):
                if lower_ascii(rest).startswith(word):
                    ids = rest[len(word) :].strip()
                    ids = ids.removesuffix("*/").strip()
                    listed = [] if word == "ignore-all" else [x.strip() for x in ids.split(",") if x.strip()]
                    return (kind, True, []) if not listed or "*" in listed else (kind, False, sorted(set(listed)))
        at = low.find(DIRECTIVE, end)
    return None


#: What `mask_stream` adds; masks are null where nothing is masked.
MASKED = "no_comments string, no_strings string, no_both string, suppress_all boolean, suppress_ids array<string>"


def suppressed_lines(lines: list[str], no_comments: list[str], before: tuple[bool, list[str]]) -> tuple[list[bool], list[list[str]], tuple[bool, list[str]]]:
    """For each line whether all rules are suppressed there, and which; `before` and the last are what the line before says of the next."""
    every, ids, low = [], [], "\n".join(lines).lower()
    if DIRECTIVE not in low:
        every, ids = [False] * len(lines), [[]] * len(lines)
        every[0], ids[0] = before
        return every, ids, (False, [])
    for line, masked in zip(lines, no_comments, strict=True):
        kind, all_rules, some = (directive(line, masked) if DIRECTIVE in line.lower() else None) or (None, False, [])
        own = kind == "same"
        every.append(before[0] or (own and all_rules))
        ids.append(sorted({*before[1], *(some if own else ())}))
        before = (all_rules, some) if kind == "next" else (False, [])
    return every, ids, before


#: Bytes of text that are scanned at a time.
SLICE = 1 << 20


def slices(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in stretches whose last columns have about SLICE bytes, however long lines are."""
    for batch in source:
        size = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // SLICE)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def same_runs(columns: list[list]) -> Iterator[tuple[tuple, int, int]]:
    """(key, from, to) of the stretches of equal rows."""
    at = 0
    for key, rows in groupby(zip(*columns, strict=True)):
        size = sum(1 for _ in rows)
        yield key, at, at + size
        at += size


def directive_after(line: str, text: str, lang: str, state: State) -> tuple[bool, list[str]]:
    """What the last line of a text, which begins in `state`, says of the line after it."""
    if DIRECTIVE not in line.lower():
        return False, []
    masked = blank(text, [(a, b) for c, a, b in scan(text, lang, True, state)[0] if c]).rsplit("\n", 1)[-1]
    kind, every, ids = directive(line, masked) or (None, False, [])
    return (every, ids) if kind == "next" else (False, [])


def mask_maps(strings: bool):
    """mapInArrow function over sorted lines, as for `mask_stream`: the key of each block and its map.

    A map lists each state that may be open before, what is open after, and what is said of the line after; then the
    same for strings alone.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = full = alone = said = None
        for batch in slices(source):
            out, content = [], [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()]
            for own, lo, hi in same_runs([batch.column(i).to_pylist() for i in range(5)]):
                text, lang = "\n".join(content[lo:hi]), own[4]
                here = exits(text, lang, True)
                says = {s: directive_after(content[hi - 1], text, lang, s) for s in here}
                if own != key:
                    if key is not None:
                        out.append((*key, told(full, said, alone)))
                    key, full, said, alone = own, here, says, exits(text, lang, False) if strings else {None: None}
                else:
                    whole = follow(full, here, lang, True)
                    said = {s: says.get(leave(full, s)) or directive_after(content[hi - 1], text, lang, leave(full, s)) for s in whole}
                    full, alone = whole, follow(alone, exits(text, lang, False), lang, False) if strings else alone
            if out:
                yield batch_of(out)
        if key is not None:
            yield batch_of([(*key, told(full, said, alone))])

    def told(full, said, alone):
        return json.dumps([[[s, o, said[s]] for s, o in full.items()], list(alone.items())])

    def batch_of(rows):
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["diff_id", "path", "run", "block", "lang", "begin"])

    return run


def state_of(value) -> State:
    return None if value is None else tuple(value)


def mask_begins(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function over the blocks of `mask_maps`, sorted: what is open, and said of the first line, where each begins."""
    run, full, alone, said = None, None, None, (False, [])
    for batch in source:
        columns, out = [c.to_pylist() for c in batch.columns], []
        for *own, _, _, text in zip(*columns, strict=True):
            if own != run:
                run, full, alone, said = own, None, None, (False, [])
            out.append(json.dumps([full, alone, said]))
            first, second = json.loads(text)
            says = {state_of(s): x for s, _, x in first}
            moved = {state_of(s): state_of(o) for s, o, _ in first}
            # Beyond the map's states the line after the block is inside what stays open, so nothing is said of it by code.
            said = says[full] if full in says else says[(full[0], beyond(moved)[1])] if not isinstance(full[1], str) else (False, [])
            full = leave(moved, full)
            alone = leave({state_of(s): state_of(o) for s, o in second}, alone) if len(second) > 1 else None
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.string())], names=["diff_id", "path", "run", "block", "begin"])


def mask_stream(strings: bool):
    """mapInArrow function that adds MASKED to lines.

    They come sorted: the first four columns tell a block of a run, the fifth is its language, the sixth how it begins (null:
    anew), the last the content. A slice at a time is held; what is open at its end goes on in the next one.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states, before = None, (None, None), (False, [])
        for batch in slices(source):
            columns = [batch.column(i).to_pylist() for i in range(6)]
            content = [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()]
            masks, every, ids = ([], [], []), [], []
            for own, lo, hi in same_runs(columns):
                if own != key:
                    key, states, before = own, (None, None), (False, [])
                    if own[5]:
                        full, alone, before = json.loads(own[5])
                        states = state_of(full), state_of(alone)
                some = content[lo:hi]
                made, states = mask_some(some, key[4], states, strings)
                more, named, before = suppressed_lines(some, made[0], before)
                for out, mask in zip(masks, made, strict=True):
                    out += [None] * len(some) if mask is some else [None if m is t or m == t else m for m, t in zip(mask, some, strict=True)]
                every += more
                ids += named
            extra = [*(pa.array(m, pa.string()) for m in masks), pa.array(every, pa.bool_()), pa.array(ids, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *(x.split(" ")[0] for x in MASKED.split(", "))])

    return run
