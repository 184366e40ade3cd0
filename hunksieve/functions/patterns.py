"""Rule patterns and globs as Java regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Unicode classes and line ends as rule patterns expect them.
FLAGS = "(?Ud)"
#: POSIX classes, which hold ASCII alone.
POSIX = {
    "alnum": r"0-9A-Za-z",
    "alpha": r"A-Za-z",
    "ascii": r"\x00-\x7F",
    "blank": r"\t\x20",
    "cntrl": r"\x00-\x1F\x7F",
    "digit": r"0-9",
    "graph": r"\x21-\x7E",
    "lower": r"a-z",
    "print": r"\x20-\x7E",
    "punct": r"\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E",
    "space": r"\t-\r\x20",
    "upper": r"A-Z",
    "word": r"0-9A-Za-z_",
    "xdigit": r"0-9A-Fa-f",
}
#: Edges of words, which Java writes as look-arounds.
EDGES = {r"\<": r"(?<!\w)(?=\w)", r"\>": r"(?<=\w)(?!\w)", r"\b{start}": r"(?<!\w)(?=\w)", r"\b{end}": r"(?<=\w)(?!\w)", r"\b{start-half}": r"(?<!\w)", r"\b{end-half}": r"(?!\w)"}
ESCAPE = re.compile(r"\\(?:[pP](?:\{[^}]*\}|.)|x(?:\{[^}]*\}|..)|u(?:\{[^}]*\}|.{4})|U(?:\{[^}]*\}|.{8})|b\{[a-z-]+\}|.)", re.DOTALL)
GROUP = re.compile(r"\(\?(?:P?<([^>=!][^>]*)>|([a-zA-Z]*)(?:-([a-zA-Z]+))?([:)]))")


class PatternError(ValueError):
    """A pattern or glob that can't be used."""


def _escape(pattern: str, i: int) -> tuple[str, int]:
    """An escape in Java's dialect, and its length."""
    m = ESCAPE.match(pattern, i)
    if not m:
        raise PatternError(f"{pattern!r} ends in a backslash")
    text = m[0]
    if text[1] in "xuU":
        digits = text[2:].strip("{}")
        if not re.fullmatch("[0-9A-Fa-f]+", digits):
            raise PatternError(f"bad escape {text!r} in {pattern!r}")
        return rf"\x{{{digits}}}", len(text)
    return text, len(text)


def _class(pattern: str, i: int, flat: bool = False) -> tuple[str, int]:
    """The class that begins at a bracket in Java's dialect, and where it ends. Set operations bind from the left."""
    start, i = i, i + 1
    negated = pattern[i : i + 1] == "^"
    i += negated
    whole, op, items, first = None, None, [], True

    def joined(left: str | None, how: str | None, right: str) -> str:
        right = right or r"[^\x{0}-\x{10FFFF}]"
        if left is None:
            return f"[{right}]"
        right = f"[{right}]"
        differs = lambda a, b: f"[{a}&&[^{b}]]"
        return {"&&": f"[{left}&&{right}]", "--": differs(left, right), "~~": f"[{differs(left, right)}{differs(right, left)}]"}[how]

    while i < len(pattern):
        c, two = pattern[i], pattern[i : i + 2]
        if c == "]" and not (first and op is None):
            whole = joined(whole, op, "".join(items))
            return (f"[^{whole}]" if negated else whole), i + 1
        if two in ("&&", "--", "~~") and not (two == "--" and pattern[i + 2 : i + 3] == "]"):
            whole, op, items, i = joined(whole, op, "".join(items)), two, [], i + 2
            continue
        first = False
        if c == "[":
            if m := re.match(r"\[:(\^?)([a-z]+):\]", pattern[i:]):
                if m[2] not in POSIX:
                    raise PatternError(f"unknown class {m[0]} in {pattern!r}")
                items.append(f"[{m[1]}{POSIX[m[2]]}]")
                i += len(m[0])
                continue
            inner, i = _class(pattern, i)
            items.append(inner)
            continue
        if c == "\\":
            text, size = _escape(pattern, i)
        else:
            text, size = (f"\\{c}" if c in "[]^-&~\\" else c), 1
        i += size
        if pattern[i : i + 1] == "-" and pattern[i + 1 : i + 2] not in ("]", "-", ""):  # a range
            high, size = _escape(pattern, i + 1) if pattern[i + 1] == "\\" else (pattern[i + 1], 1)
            text += "-" + (f"\\{high}" if high in ("[", "^", "&", "~") else high)
            i += 1 + size
        items.append(text)
    raise PatternError(f"unclosed class at {start} in {pattern!r}")


def java_pattern(pattern: str) -> str:
    """A rule pattern in Java's dialect, to be used behind FLAGS.

    Classes are read with their set operations (`&&`, `--`, `~~`), word edges become look-arounds, `^` and `$` go by the
    multi-line flag of the group that they stand in. Look-around and back-references are refused, as are flags that have
    no like in Java.
    """
    if re.search(r"\(\?(=|!|<=|<!|>)|\(\?P=", pattern):
        raise PatternError(f"look-around or back-reference in {pattern!r}")
    out, multi, names, i = [], [False], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            text, size = _escape(pattern, i)
            if text[1].isdigit() and text[1] != "0":
                raise PatternError(f"look-around or back-reference in {pattern!r}")
            if text.startswith(r"\b{") and text not in EDGES:
                raise PatternError(f"bad escape {text!r} in {pattern!r}")
            out.append(EDGES.get(text, text))
            i += size
        elif c == "[":
            text, i = _class(pattern, i)
            out.append(text)
        elif c == "(" and (m := GROUP.match(pattern, i)):
            i = m.end()
            if m[1] is not None:
                out.append(f"(?<g{names}>")
                names += 1
                multi.append(multi[-1])
                continue
            on, off = m[2] or "", m[3] or ""
            if set(on + off) - set("imsxu"):
                raise PatternError(f"flags {on}-{off} in {pattern!r}")
            now = (multi[-1] or "m" in on) and "m" not in off
            if m[4] == ":":
                multi.append(now)
            else:
                multi[-1] = now
            on, off = on.replace("u", ""), off.replace("u", "U")
            out.append(f"(?{on}{'-' + off if off else ''}{m[4]}" if on or off else "(?:" if m[4] == ":" else "")
        elif c == "(":
            multi.append(multi[-1])
            out.append(c)
            i += 1
        else:
            if c == ")" and len(multi) > 1:
                multi.pop()
            out.append({"$": r"(?=\n|\z)" if multi[-1] else r"\z", "^": r"(?:\A|(?<=\n))" if multi[-1] else r"\A"}.get(c, c))
            i += 1
    return "".join(out)


def check_pattern(spark: SparkSession, pattern: str) -> str | None:
    """What is wrong with a rule pattern, or None."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(FLAGS + java_pattern(pattern))
    except PatternError as e:
        return str(e)
    except Exception as e:
        return str(getattr(e, "java_exception", e)).splitlines()[0]
    return None


META = set("\\.^$|?*+()[]{}")


def required_text(pattern: str) -> tuple[str, bool]:
    """The longest text that every match holds as it stands, outside groups and classes; and whether it is the whole pattern."""
    if "(?" in pattern or "|" in pattern:
        return "", False
    best, run, depth, whole, i = "", "", 0, True, 0
    while i < len(pattern):
        c, size = pattern[i], 1
        if c == "[":  # a class, nested ones included
            size, nested = 1 + (pattern[i + 1 : i + 2] == "^"), 1
            size += pattern[i + size : i + size + 1] == "]"
            while nested and i + size < len(pattern):
                here = pattern[i + size]
                nested += (here == "[") - (here == "]")
                size += 1 + (here == "\\")
            c = ""
        elif c == "\\":
            c, size = (pattern[i + 1 : i + 2], 2) if pattern[i + 1 : i + 2] in META | set("-/#&~ \"'=!:,;@%`") else ("", 2)
            if pattern[i : i + 2] in (r"\p", r"\P", r"\x", r"\u", r"\U") and pattern[i + 2 : i + 3] == "{":
                size = pattern.find("}", i) + 1 - i
            elif pattern[i : i + 2] in (r"\x", r"\u", r"\U", r"\p", r"\P"):
                return "", False
        elif c in META:
            depth += (c == "(") - (c == ")")
            if c == "{":
                size = max(1, pattern.find("}", i) + 1 - i)
            c = ""
        after = pattern[i + size : i + size + 1]
        if not c or depth or after in ("?", "*", "{", "+"):
            run += c if c and not depth and after == "+" else ""
            best, run, whole = max(best, run, key=len), "", False
        else:
            run += c
        i += size
    return max(best, run, key=len), whole


def finds(text: Column, patterns: list[str]) -> Column:
    """Whether some pattern matches anywhere. Text that a pattern can't do without is looked for first."""
    out = F.lit(False)
    for p in patterns:
        java, (needed, whole) = java_pattern(p), required_text(p)
        hit = F.lit(True) if whole and needed else text.rlike(FLAGS + java)
        out = out | ((F.contains(text, F.lit(needed)) & hit) if needed else hit)
    return out


def first_match(text: Column, patterns: list[str]) -> tuple[Column, Column]:
    """Code points before and in the leftmost match of the first pattern in the list that matches; null without one."""
    before = length = F.lit(None).cast("int")
    for p in reversed(patterns):
        own = java_pattern(p)
        hit = text.rlike(FLAGS + own)
        before = F.when(hit, F.length(F.regexp_extract(text, rf"{FLAGS}\A((?s:.*?))(?:{own})", 1))).otherwise(before)
        length = F.when(hit, F.length(F.regexp_extract(text, rf"{FLAGS}\A(?s:.*?)({own})", 1))).otherwise(length)
    return before, length


def glob_regex(glob: str) -> str:
    """A path glob as a whole-string Java pattern.

    `*` and `?` also match `/`; `**/` stands for any directories or none, `/**` at the end for anything below;
    `[...]` and `[!...]` are classes, `{a,b}` alternatives, a backslash quotes.
    """
    out, depth, i = ["(?s)\\A"], 0, 0
    if glob in ("**", "**/"):
        return "(?s)\\A.*\\z"
    while i < len(glob):
        c = glob[i]
        start = i == 0 or glob[i - 1] == "/"
        if c == "*":
            n = len(re.match(r"\*+", glob[i:])[0])
            after = glob[i + n : i + n + 1]
            if n == 2 and start and after == "/":
                out.append("(?:.*/)?")
                i += 3
                continue
            if n == 2 and i > 0 and start and after == "":
                out[-1:] = ["/.+"] if out[-1] == "/" else [out[-1], ".*"]
            else:
                out.append(".*")
            i += n
            continue
        if c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", i + 2 + (glob[i + 1 : i + 2] in ("!", "^")))
            if end < 0:
                raise PatternError(f"unclosed class in glob {glob!r}")
            body = glob[i + 1 : end]
            negated = body[0] in "!^"
            body = re.sub(r"([\[\]\\&^])", r"\\\1", body[1:] if negated else body)
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}":
            if not depth:
                raise PatternError(f"unopened alternatives in glob {glob!r}")
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\":
            if i + 1 >= len(glob):
                raise PatternError(f"glob {glob!r} ends in a backslash")
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c) if c != "/" else "/")
        i += 1
    if depth:
        raise PatternError(f"unclosed alternatives in glob {glob!r}")
    return "".join([*out, "\\z"])


def matches_any(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g))
    return out


#: Stands for what a glob leaves open.
HOLE = "\0"


def glob_pieces(glob: str) -> list[str]:
    """The text of a glob between its slashes, with a HOLE for each wildcard, class and group of alternatives."""
    out, depth, i = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "[":
            i = glob.find("]", i + 2 + (glob[i + 1 : i + 2] in ("!", "^")))
        elif c == "\\":
            i += 1
        depth += (c == "{") - (c == "}")
        if c in "*?[" or (c == "{" and depth == 1):
            out += [HOLE] if not depth or c == "{" else []
        elif not depth and c != "}":
            out.append(glob[i])
        i += 1
    return "".join(out).split("/")


def glob_keys(glob: str) -> list[str]:
    """Keys that every path has which the glob matches, as `path_keys` gives them; none if it leaves too much open.

    Folders that it begins with (d), whole names in it (s), beginnings (h) and ends (x) of names up to and from a dot;
    without any of those all trigrams (t) of its text.
    """
    if glob in ("**", "**/"):
        return []
    pieces = glob_pieces(glob)
    keys = {f"s{p}" for p in pieces if HOLE not in p}
    n = next((i for i, p in enumerate(pieces) if HOLE in p), len(pieces) - 1)
    if folder := "/".join(pieces[:n]):
        keys.add(f"d{folder}")
    for p in pieces:
        head = p.split(HOLE)[0]
        if HOLE in p and "." in head:
            keys.add(f"h{head[: head.rindex('.') + 1]}")
    tail = pieces[-1].split(HOLE)[-1]
    if HOLE in pieces[-1] and "." in tail:
        keys.add(f"x{tail[tail.index('.') :]}")
    runs = [] if keys else [r for p in pieces for r in p.split(HOLE)]
    return sorted(keys or {f"t{r[i : i + 3]}" for r in runs for i in range(len(r) - 2)})


def path_keys(path: Column) -> Column:
    """All keys of a path, each once."""
    parts = F.split(path, "/")
    ups = lambda x: F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda n: n > 0)
    dotted = lambda name: F.split(name, r"\.")
    dirs = F.transform(ups(parts), lambda n: F.concat(F.lit("d"), F.array_join(F.slice(parts, 1, n), "/")))
    names = F.transform(parts, lambda p: F.concat(F.lit("s"), p))
    heads = F.flatten(F.transform(parts, lambda p: F.transform(ups(dotted(p)), lambda n: F.concat(F.lit("h"), F.array_join(F.slice(dotted(p), 1, n), "."), F.lit(".")))))
    last = dotted(F.element_at(parts, -1))
    tails = F.transform(ups(last), lambda n: F.concat(F.lit("x."), F.array_join(F.slice(last, n + 1, F.size(last)), ".")))
    threes = F.transform(F.sequence(F.lit(1), F.greatest(F.length(path) - 2, F.lit(1))), lambda n: F.concat(F.lit("t"), F.substr(path, n, F.lit(3))))
    return F.array_distinct(F.concat(dirs, names, heads, tails, threes))
