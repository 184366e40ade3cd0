"""Unified diffs as a parser whose steps compose, so that one diff is parsed in many tasks.

What a stretch of lines does to the state of the parser is a map. Few states differ in what they do next: whether there
is a path, a name that waits for its `+++` line, a file that is skipped, a hunk that is open. A stretch is tried with
each of these, with the path, the name and the line numbers left open; the outcomes are its map. Maps of neighbouring
stretches compose. A `diff` header makes all states alike, so most stretches are tried once.

Only header lines are looked at one by one. The lines of hunks are counted as arrays.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import astuple, dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..constants import MAX_U32

ESCAPES = {"n": 10, "t": 9, "r": 13, "\\": 92, '"': 34, " ": 32}
#: What Unicode calls white space.
SPACES = re.compile(r"[\t\n\x0b\x0c\r \x85\xa0  -     　]+")
HUNK = re.compile(r"@@\S*\s+-\+?(\d+)(?:,\S*)?\s+\++?(\d+)(?:,\S*)?(?:\s|\Z)", re.ASCII)


def plain_path(token: str) -> str | None:
    """Without a/ or b/, double slashes, inner `.` and slashes at the end; none if nothing is left."""
    token = token.strip()
    token = token[2:] if token.startswith(("a/", "b/")) else token
    parts = [x for i, x in enumerate(token.split("/")) if x and (x != "." or i == 0)]
    return ("/" if token.startswith("/") else "") + "/".join(parts) or None


def quoted_tokens(text: str) -> list[str]:
    """Space-separated tokens, of which some stand in double quotes with backslash and octal escapes."""
    tokens, data, quoted, i = [], bytearray(), False, 0
    while i < len(text):
        c = text[i]
        if quoted and c == "\\" and i + 1 < len(text):
            octal = ""
            while len(octal) < 3 and text[i + 1 + len(octal) : i + 2 + len(octal)] in tuple("01234567"):
                octal += text[i + 1 + len(octal)]
            if octal:
                data.append(int(octal, 8) & 255)
                i += len(octal)
            elif text[i + 1] in ESCAPES:
                data.append(ESCAPES[text[i + 1]])
                i += 1
            else:
                data += text[i : i + 2].encode()
                i += 1
        elif c == '"':
            quoted = not quoted
        elif c.isspace() and not quoted:
            if data:
                tokens.append(data.decode(errors="replace"))
            data = bytearray()
        else:
            data += c.encode("utf-8", "surrogatepass")
        i += 1
    return [*tokens, data.decode(errors="replace")] if data else tokens


def tokens_of(text: str) -> list[str]:
    return quoted_tokens(text) if '"' in text else [x for x in SPACES.split(text) if x]


Event = tuple[str, object]


def event(line: str) -> Event | None:
    """What a header line says: its kind, and the path, name or line numbers."""
    if line.startswith("diff --git "):
        tokens = tokens_of(line[11:])
        return "git", plain_path(tokens[1]) if len(tokens) > 1 else None
    if (line.startswith("Binary files ") and " differ" in line) or line.startswith("Subproject commit "):
        return "skip", True
    if line.startswith("deleted file mode "):
        return "gone", None
    if line.startswith("rename to "):
        rest = line[10:]
        name = (quoted_tokens(rest) or [None])[0] if '"' in rest and rest.strip().startswith('"') else rest.strip(None if '"' in rest else " ")
        return ("to", name) if rest.strip(" ") and name else None
    if line.startswith("+++ "):
        tokens = tokens_of(line[4:])
        return "plus", None if not tokens or tokens[0] == "/dev/null" else plain_path(tokens[0])
    if line.startswith("@@"):
        m = HUNK.match(line)
        old, new = (int(m[1]), int(m[2])) if m else (MAX_U32 + 1, 0)
        return "hunk", (old, new) if max(old, new) <= MAX_U32 else None
    if line[:1] in ("+", "-") and line.startswith("Subproject commit ", 1):
        return "module", None
    return None


#: Stands for the path, the waiting name or a number of the state before a stretch. Texts of a diff begin with `=` in a state.
PATH, NAME = "path", "name"


@dataclass(frozen=True)
class State:
    """Between two lines. Line numbers are (counted from those before, number); changed is None for what it was before."""

    path: str | None = None
    name: str | None = None
    skip: bool = False
    inside: bool = False
    old: tuple[bool, int] = (False, 0)
    new: tuple[bool, int] = (False, 0)
    changed: bool | None = False

    def kind(self) -> tuple[bool, bool, bool, bool]:
        return self.path is not None, self.name is not None, self.skip, self.inside

    def after(self, before: State) -> State:
        """This state, which a map gives for the kind of `before`, with what it leaves open filled in."""
        text = lambda x: {PATH: before.path, NAME: before.name}.get(x, x)
        number = lambda x, own: (own[0], own[1] + x[1]) if x[0] else x
        return State(text(self.path), text(self.name), self.skip, self.inside, number(self.old, before.old), number(self.new, before.new), before.changed if self.changed is None else self.changed)


START = State()
KINDS = [State(PATH if path else None, NAME if name else None, skip, inside, (True, 0), (True, 0), None) for path, name, skip, inside in product((False, True), repeat=4)]
Map = dict[tuple[bool, bool, bool, bool], State]
SAME: Map = {s.kind(): s if s.inside else State(s.path, s.name, s.skip) for s in KINDS}


def then(first: Map, second: Map) -> Map:
    return {kind: second[s.kind()].after(s) for kind, s in first.items()}


def packed(m: Map) -> str:
    """A map as text; one that takes all states to the same has it once."""
    states = [astuple(s) for s in m.values()]
    return json.dumps(states[:1] if all(s == states[0] for s in states) else states)


def unpacked(text: str) -> Map:
    states = [State(*(tuple(x) if isinstance(x, list) else x for x in s)) for s in json.loads(text)]
    return dict(zip(SAME, states * (len(SAME) // len(states)), strict=True))


class Lines:
    """Lines of one stretch: header lines with their places, and the others by their first character."""

    def __init__(self, raw: pa.Array):
        raw = raw.fill_null("")
        offsets = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)
        size = np.diff(offsets)

        def at(k: int) -> np.ndarray:
            return np.where(size > k, data[np.minimum(offsets[:-1] + k, max(len(data) - 1, 0))] if len(data) else 0, 0)

        first, second, third = at(0), at(1), at(2)
        tripled = (first == second) & (second == third)
        self.sign = np.where(np.isin(first, [43, 45, 32]) & ~((first != 32) & tripled), first, 0).astype(np.uint8)
        signed = (self.sign == 43) | (self.sign == 45)
        maybe = np.isin(first, list(b"dBSr@")) | ((first == 43) & tripled) | (signed & (second == 83) & (third == 117))
        self.events = [(i, e) for i, line in zip(np.flatnonzero(maybe).tolist(), raw.take(pa.array(np.flatnonzero(maybe))).to_pylist(), strict=True) if (e := event(line))]
        for i, (kind, _) in self.events:
            if kind == "module":
                self.sign[i] = 0

    def split(self, begin: int, end: int) -> tuple[np.ndarray, list[tuple[int, Event]]]:
        """The signs and events of some lines, with places counted from `begin`."""
        return self.sign[begin:end], [(i - begin, e) for i, e in self.events if begin <= i < end]


def walk(sign: np.ndarray, events: list[tuple[int, Event]], state: State, keep_deleted: bool) -> tuple[State, dict[str, np.ndarray | list]]:
    """The state after the lines, and of each stretch between events where it begins, whether its lines count, its path, and
    for its hunk the line at which it begins, the numbers there and whether a removed line came last."""
    begin, counts, paths, hunk = [0], [state.inside and not state.skip and state.path is not None], [state.path], [(0, state.old, state.new, state.changed)]
    path, name, skip, inside, own = state.path, state.name, state.skip, state.inside, hunk[0]
    for i, (kind, told) in events:
        if kind == "start":  # another diff or block
            path, name, skip, inside = told.path, told.name, told.skip, told.inside
            own = (i, told.old, told.new, told.changed)
        elif kind == "git":
            name, skip, inside = None, False, False
            path = f"={told}" if told is not None else path
        elif kind == "skip":
            skip = True
        elif kind == "gone":
            skip = not keep_deleted
        elif kind == "to":
            name = f"={told}"
            continue
        elif kind == "plus":
            path = name if name is not None else f"={told}" if told is not None else path
            name = None
        elif kind == "hunk":
            if skip:
                continue
            inside = told is not None
            if inside:
                own = (i + 1, (False, told[0]), (False, told[1]), False)
        elif kind == "module" and inside and not skip and path is not None:
            skip, inside = True, False
        begin.append(i)
        counts.append(inside and not skip and path is not None)
        paths.append(path)
        hunk.append(own)
    n = len(sign)
    size = np.diff([*begin, n])
    live = np.where(np.repeat(counts, size), sign, 0)
    new, old = np.append(0, np.cumsum((live == 43) | (live == 32))), np.append(0, np.cumsum((live == 45) | (live == 32)))
    marked = np.where((live == 45) | (live == 32), np.arange(n), -1)
    last = np.append(-1, np.maximum.accumulate(marked)) if n else np.array([-1])
    at, old_at, new_at, changed = own
    moved = lambda base, count: (base[0], base[1] + int(count[n] - count[at]))
    changed = bool(live[last[n]] == 45) if last[n] >= at else changed
    done = State(path, name, skip, inside, moved(old_at, old), moved(new_at, new), changed) if inside else State(path, name, skip)
    return done, {"size": size, "paths": paths, "hunk": hunk, "live": live, "new": new, "old": old, "last": last}


def map_of(sign: np.ndarray, events: list[tuple[int, Event]], keep_deleted: bool) -> Map:
    sure = max((k for k, (_, (kind, told)) in enumerate(events) if kind == "git" and told is not None), default=None)
    if sure is not None:  # what came before doesn't count
        at = events[sure][0]
        done = walk(sign[at:], [(i - at, e) for i, e in events[sure:]], START, keep_deleted)[0]
        return dict.fromkeys(SAME, done)
    return {s.kind(): walk(sign, events, s, keep_deleted)[0] for s in KINDS}


def rows_of(sign: np.ndarray, events: list[tuple[int, Event]], state: State, scope: str) -> tuple[State, np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The state after the lines; of the lines in scope their places, the paths, which path, the line number, and changed."""
    done, told = walk(sign, events, state, scope == "deleted")
    live, last = told["live"], told["last"]
    stretch = np.repeat(np.arange(len(told["size"])), told["size"])
    mark = 45 if scope == "deleted" else 43
    at = np.flatnonzero(live == mark)
    own = stretch[at]
    begin, before = np.array([h[0] for h in told["hunk"]])[own], np.array([bool(h[3]) for h in told["hunk"]])[own]
    which, count = ("old", 1) if scope == "deleted" else ("new", 2)
    base = np.array([h[count][1] for h in told["hunk"]], dtype=np.int64)[own]
    line = np.minimum(base + told[which][at] - told[which][begin], MAX_U32)
    changed = np.where(last[at] >= begin, live[np.maximum(last[at], 0)] == 45, before)
    if scope not in ("added", "deleted"):
        at, own, line, changed = at[changed], own[changed], line[changed], changed[changed]
    return done, at, [p[1:] if p else "" for p in told["paths"]], own, line, changed


def stretches_of(diff: pa.Array, block: pa.Array) -> list[int]:
    """Where lines of another diff or block begin, and the end."""
    n = len(diff)
    codes = diff.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    blocks = block.to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1).tolist(), n] if n else [0]


def summarise(keep_deleted: bool):
    """mapInArrow function over sorted (diff_id, block, pos, raw): diff_id, block and the map of each block."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sofar, out = None, None, []
        for batch in source:
            diff, block, lines = batch.column(0), batch.column(1), Lines(batch.column(3))
            cuts = stretches_of(diff, block)
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = diff[a].as_py(), block[a].as_py()
                if own != key:
                    if key is not None:
                        out.append((*key, packed(sofar)))
                    key, sofar = own, SAME
                sofar = then(sofar, map_of(*lines.split(a, b), keep_deleted))
            if out:
                yield told(out)
                out = []
        if key is not None:
            yield told([(*key, packed(sofar))])

    def told(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["diff_id", "block", "map"])

    return run


def carry(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function over sorted (diff_id, block, map): the state in which each block begins, as a map."""
    diff, state = None, START
    for batch in source:
        out = []
        for own, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if own != diff:
                diff, state = own, START
            out.append(json.dumps([astuple(state)]))
            state = unpacked(text)[state.kind()].after(state)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["diff_id", "block", "map"])


class Emitter:
    """The lines in scope of sorted (diff_id, block, pos, raw, map), batch after batch. Blocks without a map begin anew."""

    def __init__(self, scope: str):
        self.scope, self.key, self.state = scope, None, START

    def of(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        diff, block, pos, raw, maps = batch.columns
        lines, begins = Lines(raw), []
        for a in stretches_of(diff, block)[:-1]:
            own = diff[a].as_py(), block[a].as_py()
            if own != self.key:
                text = maps[a].as_py()
                self.key = own
                begins.append((a, ("start", unpacked(text)[START.kind()] if text else START)))
        events = sorted([*begins, *lines.events], key=lambda e: e[0])  # a start comes before what its line says
        self.state, at, paths, which, line, changed = rows_of(lines.sign, events, self.state, self.scope)
        path = pa.array([p or "" for p in paths], pa.string()).take(pa.array(which))
        kind = pa.array(["added", "changed", "deleted"]).take(pa.array(np.full(len(at), 2) if self.scope == "deleted" else changed.astype(np.int64)))
        rows = pa.array(at)
        content = pc.utf8_slice_codeunits(raw.take(rows), 1)
        return pa.RecordBatch.from_arrays([diff.take(rows), pos.take(rows), path, pa.array(line, pa.int64()), content, kind], names=["diff_id", "idx", "path", "line", "content", "kind"])


def emit(scope: str):
    """mapInArrow function over sorted (diff_id, block, pos, raw, map): the lines in scope."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(Emitter(scope).of, source)

    return run


def parse_lines(lines: list[str], scope: str, state: State = START) -> tuple[list[tuple], State]:
    """(place, path, line, content, kind) of the lines in scope, and the state after: what the tasks do, for a few lines."""
    some = Lines(pa.array(lines, pa.string()))
    done, at, paths, which, line, changed = rows_of(some.sign, some.events, state, scope)
    kinds = ["deleted"] * len(at) if scope == "deleted" else ["changed" if c else "added" for c in changed.tolist()]
    return [(i, paths[p], n, lines[i][1:], k) for i, p, n, k in zip(at.tolist(), which.tolist(), line.tolist(), kinds, strict=True)], done


def map_lines(lines: list[str], keep_deleted: bool = False) -> Map:
    some = Lines(pa.array(lines, pa.string()))
    return map_of(some.sign, some.events, keep_deleted)


__all__ = ["SAME", "START", "Emitter", "State", "carry", "emit", "event", "map_lines", "parse_lines", "plain_path", "quoted_tokens", "summarise", "then"]
