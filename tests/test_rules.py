"""Patterns, globs, masks, directives, rules and evaluation."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hunksieve.functions import masking, patterns
from hunksieve.functions import text as tx
from hunksieve.functions.lang import language_of, parse_language
from hunksieve.operators import evaluate, history, packs, rules, verdict
from hunksieve.operators.rules import Rule, RuleError, TestCase
from hunksieve.plans.check import Plan, run_check
from hunksieve.schemas import FP_ENTRY, LINES
from hunksieve.sources.presets import BUILT_IN, PRESETS


def lines(spark, rows, diff="d"):
    return spark.createDataFrame([(diff, i, p, n, c, "added") for i, (p, n, c) in enumerate(rows)], LINES)


def found(spark, rows, pack, **how):
    got = evaluate.find_events(lines(spark, rows), pack, **how).orderBy("at", "rule_idx").collect()
    return [(r.rule_id, r.path, r.line, None if r.start is None else r.start + 1, r.match_text, r.severity, r.suppressed) for r in got]


GLOBS = [
    ("**/tests/**", ["tests/test.rs", "a/tests/b/c"], ["tests", "a/mytests/x"]),
    ("*.rs", ["a.rs", "d/a.rs"], ["a.rsx"]),
    ("**/*.rs", ["a.rs", "x/y/a.rs"], ["a.py"]),
    ("src/**/*.ts", ["src/a.ts", "src/b/c/a.ts"], ["lib/src/a.ts"]),
    ("a?c", ["abc", "a/c"], ["ac"]),
    ("{a,b*}.txt", ["a.txt", "bcd.txt"], ["c.txt"]),
    ("[a-c]x", ["ax", "cx"], ["dx"]),
    ("[!a]x", ["bx"], ["ax"]),
    ("**/*.test.*", ["x/a.test.js"], ["a.js"]),
    ("x/**", ["x/y", "x/y/z"], ["x"]),
    (r"\*a", ["*a"], ["ba"]),
    ("a.b", ["a.b"], ["axb"]),
]


@pytest.mark.parametrize("glob,yes,no", GLOBS)
def test_globs(glob, yes, no):
    pattern = re.compile(patterns.glob_regex(glob).replace(r"\z", r"\Z"))
    assert all(pattern.match(p) for p in yes) and not any(pattern.match(p) for p in no)


def test_bad_globs():
    for bad in ("[a", "{a", "a}", "a\\"):
        with pytest.raises(patterns.PatternError):
            patterns.glob_regex(bad)


def test_pattern_dialect(spark):
    cases = [
        (r"\bfoo", "éfoo", False), (r"(?i)é", "É", True), (r"x\sy", "x y", True), (r"\d", "٣", True), ("a.b", "a b", True),
        ("a$", "a\r", False), ("a$", "a", True), ("[[:alpha:]]+", "ab", True), ("[[:^digit:]]", "1", False), ("(?m)a$", "a\nb", True), (r"\$x", "$x", True), ("[$]", "$", True), ("(?P<n>a)b", "ab", True),
    ]
    frame = spark.createDataFrame([(t,) for _, t, _ in cases], "t string")
    got = frame.select(*(F.max((F.col("t") == t) & patterns.finds(F.col("t"), [p])).alias(f"c{i}") for i, (p, t, _) in enumerate(cases))).first()
    assert list(got) == [want for *_, want in cases]
    for bad in ("(?=a)", "(?<!a)b", r"(a)\1"):
        with pytest.raises(patterns.PatternError):
            patterns.java_pattern(bad)
    assert patterns.check_pattern(spark, "(") and patterns.check_pattern(spark, "(?=a)") and patterns.check_pattern(spark, "a+") is None


def test_languages(spark):
    paths = {"a.rs": "rust", "x/b.PY": "python", "c.tsx": "typescript", ".rs": None, "d/.rs": None, "noext": None, "e.htm": "xml", "f.xyz": None, "g.tar.yml": "yaml"}
    frame = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.l for r in frame.select("p", language_of(F.col("p")).alias("l")).collect()} == paths
    assert [parse_language(x) for x in ("Bash", "HTML", "yml", "rust", "cobol")] == ["shell", "xml", "yaml", "rust", "unknown"]


MASKS = [
    ("rust", ['let x = "a // b"; // c "d"'], ['let x = "a // b";         '], ["let x =         ; // c    "], ["let x =         ;         "]),
    ("rust", ['r#"x " y"# z', "/* a /* b */ c */ d"], ['r#"x " y"# z', "                  d"], None, ["           z", "                  d"]),
    ("rust", ["fn f<'a>() {}", "x"], ["fn f<'a>() {}", "x"], ["fn f<        ", " "], None),
    ("python", ["x = '''a", "# b", "''' # c"], ["x = '''a", "# b", "'''    "], ["x =     ", "   ", "    # c"], ["x =     ", "   ", "       "]),
    ("javascript", ["a `b", "// c` d // e"], ["a `b", "// c` d     "], ["a   ", "      d // e"], ["a   ", "      d     "]),
    ("go", ["`a\\` b 'c' // d"], ["`a\\` b 'c'     "], None, ["     b 'c'     "]),
    ("shell", ["echo 'a\\' b $'c\\'d' # e"], ["echo 'a\\' b $'c\\'d'    "], ["echo      b         # e"], None),
    ("sql", ["a 'b''c\"' \"d\" -- e", "/* f", "*/ g"], ["a 'b''c\"' \"d\"     ", "    ", "   g"], ["a         \"d\" -- e", "/* f", "*/ g"], None),
    ("xml", ["<a b='c'> <!-- d", "e --> f"], ["<a b='c'>       ", "      f"], None, ["<a b=   >       ", "      f"]),
    ("php", ["a # b", "c /* d */ e // f"], ["a    ", "c         e     "], None, None),
    ("c", ["'\\'' \"a\\", "b\" /* c */ d"], ["'\\'' \"a\\", "b\"         d"], ["        ", "   /* c */ d"], None),
    ("unknown", ["é \"ü\" // ß"], ["é \"ü\"     "], ["é     // ß"], ["é         "]),
    ("ruby", ["'a' `b` # c"], ["'a' `b`    "], ["        # c"], None),
    ("python", ["# it's", "x = 1"], ["      ", "x = 1"], ["# it  ", "     "], None),
    ("swift", ['"""a', 'b""" \'c\''], None, ["    ", "     'c'"], None),
]


@pytest.mark.parametrize("lang,text,comments,strings,both", MASKS)
def test_masks(lang, text, comments, strings, both):
    got = masking.mask_lines(text, lang)
    for want, have in ((comments, 0), (strings, 1), (both, 2)):
        if want is not None:
            assert [x[have] for x in got] == [w.ljust(len(t)) if len(w) < len(t) else w for w, t in zip(want, text, strict=True)]
    assert all(len(m) == len(t) for x, t in zip(got, text, strict=True) for m in x)


def test_directives():
    say = lambda x, m=None: masking.directive(x, m)
    assert say("// hunksieve: ignore a.b, c */") == ("same", False, ["a.b", "c"])
    assert say("# HunkSieve:IGNORE-NEXT-LINE x") == ("next", False, ["x"])
    assert say("hunksieve: ignore-all x") == say("hunksieve: ignore") == say("hunksieve: ignore *") == say("hunksieve: ignore a, *") == ("same", True, [])
    assert say("hunksieve: other") is None and say("nothing") is None
    assert say("hunksieve: no hunksieve: ignore z") == ("same", False, ["z"])
    text = '"hunksieve: ignore a" // hunksieve: ignore b'
    assert say(text, masking.mask_lines([text], "c")[0][0]) == ("same", False, ["b"])


def test_evaluation(spark):
    rust = Rule("no", "error", "m", languages=("rust",), patterns=(r"\.unwrap\(",), paths=("**/*.rs",), exclude_paths=("**/tests/**",), ignore_comments=True, ignore_strings=True)
    rows = [("a.rs", 1, "x.unwrap() // .unwrap("), ("a.rs", 2, '// .unwrap( ".unwrap("'), ("a.rs", 9, "y.unwrap() // hunksieve: ignore no"), ("tests/b.rs", 1, "x.unwrap()"), ("c.py", 1, "x.unwrap()"), ("d.rs", 3, "😀é.unwrap(.unwrap(")]
    assert found(spark, rows, [rust]) == [("no", "a.rs", 1, 2, ".unwrap(", "error", False), ("no", "a.rs", 9, 2, ".unwrap(", "error", True), ("no", "d.rs", 3, 3, ".unwrap(", "error", False)]
    assert [x[1] for x in found(spark, rows, [rust], language="Rust")] == ["a.rs", "a.rs", "d.rs"]
    assert found(spark, rows, []) == []


def test_suppression_window(spark):
    rule = Rule("r", "warn", "", patterns=("bad",))
    rows = [("a.py", 1, "# hunksieve: ignore-next-line r"), ("a.py", 2, "bad"), ("a.py", 3, "bad"), ("a.py", 4, "x # hunksieve: ignore-next-line"), ("b.py", 1, "bad"), ("a.py", 5, 'bad "hunksieve: ignore"'), ("a.py", 6, "bad # hunksieve: ignore other")]
    assert [(x[1], x[2], x[6]) for x in found(spark, rows, [rule])] == [("a.py", 2, True), ("a.py", 3, False), ("b.py", 1, False), ("a.py", 5, False), ("a.py", 6, False)]


def test_windows(spark):
    rows = [("a.go", n, c) for n, c in ((1, "open"), (50, "use x"), (51, "y"), (52, "z"), (90, "use y"), (91, "danger"))]
    context = Rule("ctx", "info", "", patterns=("use",), context_patterns=("open",), context_window=1)
    raised = Rule("esc", "info", "", patterns=("use",), escalate_patterns=("danger",), escalate_window=1, escalate_to="warn")
    default = Rule("def", "warn", "", patterns=("danger",), escalate_patterns=("danger",))
    multi = Rule("mul", "info", "", patterns=(r"x\ny",), multiline=True)
    absent = Rule("abs", "warn", "", patterns=("license",), match_mode="absent", paths=("*.go",))
    got = found(spark, rows, [context, raised, default, multi, absent])
    assert got == [
        ("abs", "a.go", 1, None, "<absent>", "warn", False),
        ("ctx", "a.go", 50, 1, "use", "info", False),
        ("esc", "a.go", 50, 1, "use", "info", False),
        ("mul", "a.go", 50, 5, "x\ny", "info", False),
        ("esc", "a.go", 90, 1, "use", "warn", False),
        ("def", "a.go", 91, 1, "danger", "error", False),
    ]
    one = Rule("one", "info", "", patterns=("a",), multiline=True)
    assert found(spark, [("x.txt", 1, "a")], [one]) == []
    late = Rule("late", "info", "", patterns=("b",), multiline=True, multiline_window=3)
    assert [(x[2], x[3]) for x in found(spark, [("x.txt", 1, "a"), ("x.txt", 2, "cb"), ("x.txt", 3, "b")], [late])] == [(2, 2)]


def test_dependencies(spark):
    pack = [Rule("a", "info", "", patterns=("a",), depends_on=("b",)), Rule("b", "info", "", patterns=("b",), depends_on=("c",)), Rule("c", "info", "", patterns=("c",)), Rule("x", "info", "", patterns=("x",), depends_on=("y",)), Rule("y", "info", "", patterns=("y",), depends_on=("x",))]
    rows = [("1", 1, "a b c"), ("2", 1, "a b"), ("3", 1, "a c x y"), ("4", 1, "y")]
    assert Counter((x[1], x[0]) for x in found(spark, rows, pack)) == Counter([("1", "a"), ("1", "b"), ("1", "c"), ("3", "c"), ("3", "x"), ("3", "y")])
    with pytest.raises(RuleError):
        found(spark, rows, [Rule("a", "info", "", patterns=("a",), depends_on=("zz",))])


def test_overrides(spark):
    rule = Rule("r", "warn", "", patterns=("x",))
    rows = [("a/f.py", 1, "x"), ("a/b/f.py", 1, "x"), ("a/b/gen/f.py", 1, "x"), ("ab/f.py", 1, "x")]
    specs = [
        {"directory": "a/b", "rule_id": "r", "severity": "error", "exclude_paths": ["gen/**"]},
        {"directory": "a", "rule_id": "r", "enabled": False},
        {"directory": "./a/b/", "rule_id": "r", "enabled": True},
    ]
    assert [(x[1], x[5]) for x in found(spark, rows, [rule], overrides=specs)] == [("a/b/f.py", "error"), ("a/b/gen/f.py", "error"), ("ab/f.py", "warn")]
    assert [(x[1], x[5]) for x in found(spark, rows, [rule], overrides=specs[1::-1])] == [("ab/f.py", "warn")]


def test_cap_and_counts(spark):
    pack = [Rule("a", "error", "ma", patterns=("p",)), Rule("b", "info", "mb", patterns=("p",))]
    rows = [("f.py", n, "  p # hunksieve: ignore b" if n == 2 else "  p  ") for n in range(1, 5)]
    events = evaluate.find_events(lines(spark, rows), pack)
    top = evaluate.findings(events, pack, 3).orderBy("n").collect()
    assert [(r.rule_id, r.line, r.column, r.snippet) for r in top] == [("a", 1, 3, "  p"), ("b", 1, 3, "  p"), ("a", 2, 3, "  p # hunksieve: ignore b")]
    assert verdict.verdict_counts(events, 3).drop("diff_id").first().asDict() == {"info": 3, "warn": 0, "error": 4, "suppressed": 1, "truncated": 4}
    hits = {r.rule_id: (r.total, r.emitted, r.suppressed, r.info, r.error) for r in verdict.rule_hits(events).collect()}
    assert hits == {"a": (4, 4, 0, 0, 4), "b": (4, 3, 1, 3, 0)}


def test_check(spark):
    pack = [Rule("a", "error", "ma", patterns=("p",), tags=("T",)), Rule("b", "warn", "mb", patterns=("q",))]
    rows = [("x/f.py", 1, "p"), ("x/f.py", 1, "p"), ("x/f.py", 2, "q"), ("y/f.py", 1, "p"), ("x/f.py", 3, "p")]
    run = run_check(lines(spark, rows), pack, Plan(path_filters=("x/*",), fail_on="warn"))
    s = run.summary.first()
    assert (s.files_scanned, s.lines_scanned, s.error, s.warn, s.status, s.exit_code) == (1, 3, 2, 1, "fail", 2)
    allowed = spark.createDataFrame([("x/f.py", 2)], "path string, line long")
    s = run_check(lines(spark, rows), pack, Plan(fail_on="warn"), allowed=allowed).summary.first()
    assert (s.error, s.warn, s.status, s.exit_code) == (0, 1, "warn", 3)
    s = run_check(lines(spark, rows), pack, Plan(only_tags=("t",))).summary.first()
    assert (s.error, s.warn) == (3, 0)
    base = history.entries_of(run.findings.where("line <> 2").drop("n", "diff_id"))
    again = run_check(lines(spark, rows), pack, Plan(path_filters=("x/*",)), baseline=base)
    s = again.summary.first()
    assert (s.error, s.warn, s.status, again.findings.count(), again.acknowledged.count()) == (0, 1, "warn", 1, 2)
    assert {r.rule_id: (r.emitted, r.false_positive) for r in again.rule_hits.collect()} == {"a": (0, 2), "b": (1, 0)}
    assert run.receipt().first().verdict.counts.error == 2 and "| error | `a` |" in run.markdown().first().page
    none = run_check(lines(spark, rows), [], Plan())
    assert none.summary.first().status == "pass" and none.findings.count() == 0 and "No findings." in none.markdown().first().page


def test_rule_sets(spark):
    a, b = Rule("a", patterns=("x",), tags=("One",)), Rule("b", patterns=("y",), tags=("two",))
    assert rules.merge([b, a], [rules.replace(a, severity="info")])[0].severity == "info"
    pick = lambda **k: [r.id for r in rules.select_by_tags([a, b], **k)]
    assert (pick(only=["ONE"]), pick(only=["one"], enable=["Two"]), pick(disable=["two"]), pick(enable=["two"])) == (["a"], ["a", "b"], ["a"], ["a", "b"])
    bad = [Rule("d", patterns=("(",)), Rule("d", patterns=(), multiline=True, multiline_window=1, depends_on=("q",)), Rule("e", patterns=("x",), paths=("[",))]
    assert len(rules.validate(spark, bad)) == 6 and len(rules.validate(spark, [a], strict=True)) == 4
    cases = (TestCase("x1", True), TestCase("q", False), TestCase("q", True))
    assert [r.passed for r in rules.self_test(spark, [rules.replace(a, test_cases=cases), b]).orderBy("case").collect()] == [True, True, False]
    ids = rules.rules_table(spark, BUILT_IN)
    assert [r.id for r in rules.suggest(ids, "rust.no_unwrp").collect()] == ["rust.no_unwrap"]
    assert [r.id for r in rules.suggest(ids, "RUST").collect()] == ["rust.no_dbg", "rust.no_unwrap"]
    assert "Patterns: x" in rules.explain(a)
    assert [len(PRESETS[p]) for p in PRESETS] == [0, 6, 7, 6, 7] and len(BUILT_IN) == 8
    for r in [*BUILT_IN, *(r for p in PRESETS.values() for r in p)]:
        rules.check([r])
        assert rules.validate(spark, [r]) == []


def test_history(spark):
    entries = spark.createDataFrame([("f", "r", "p", 1, "old"), ("f", "a", "p", 2, None), ("g", "r", "q", 3, None)], FP_ENTRY)
    new = spark.createDataFrame([("f", "", "n", 0, None), ("h", "r", "s", 4, "x")], FP_ENTRY)
    merged = {r.fingerprint: tuple(r)[1:] for r in history.merge_baselines(entries, new).collect()}
    assert merged == {"f": ("a", "n", 2, None), "g": ("r", "q", 3, None), "h": ("r", "s", 4, "x")}
    runs = spark.createDataFrame([(i, {"info": i, "warn": 0, "error": 0, "suppressed": 0}, i * i) for i in range(4)], "seq long, counts struct<info: long, warn: long, error: long, suppressed: long>, findings long")
    assert history.trend_delta(runs).first().findings == 5 and history.trend_delta(runs.limit(1)).count() == 0
    assert [r.seq for r in history.latest_runs(runs, 2).collect()] == [3, 2]
    assert history.append_run(runs, runs.where("seq = 0"), 2).agg(F.max("seq"), F.count("*")).first()[:] == (4, 2)
    assert history.trend_totals(runs.limit(0)).first()[:] == (0, 0, 0, 0, 0, 0)
    with pytest.raises(ValueError):
        history.latest_runs(runs, 0)


def test_scalars(spark):
    text = "a|b`c#d*e_f[g]h>i\r\n<&\"'\x01"
    row = spark.createDataFrame([(text, "x" * 300 + " ", "a😀b")], "t string, l string, u string").select(
        tx.escape_markdown(F.col("t")), tx.escape_xml(F.col("t")), tx.snippet(F.col("l")), tx.utf16_length(F.col("u")), tx.quote_csv(F.col("t")), tx.escape_tsv(F.lit("a\tb\\\n")), tx.normal_path(F.lit(".\\a\\b"))
    )
    got = row.first()
    assert got[0] == "a\\|b\\`c\\#d\\*e\\_f\\[g\\]h\\>i\\r\\n<&\"'\x01"
    assert got[1] == "a|b`c#d*e_f[g]h&gt;i\r\n&lt;&amp;&quot;&apos;&#x1;"
    assert got[2] == "x" * 240 + "…" and got[3] == 4 and got[4].startswith('"a|b') and '""' in got[4]
    assert got[5] == "a\\tb\\\\\\n" and got[6] == "a/b"


def test_packs_in_tables(spark):
    """Rules as rows against the same rules one by one: required texts, none, several patterns, directives."""
    rng = random.Random(12)
    words = ["alpha", "beta", "gamma", "delta", "été", "naïve", "x1", "zz"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(9))) + rng.choice(["", " // hunksieve: ignore p.1, p.3", " // hunksieve: ignore-all"]) for _ in range(120)] + [""]
    lines = spark.createDataFrame([(f"d{i % 3}", i, f"f{i % 7}.rs", i, t, "added") for i, t in enumerate(texts)], "diff_id string, idx long, path string, line long, content string, kind string")
    patterns = [("alpha b",), (r"\bgam+a\b", "delta"), ("é+t",), ("zz",), (r"[a-z]\d",), ("naïve [a-z]+", "na"), ("(?i)BETA",), ("nowhere",), ("a|b",), ()]
    pack = [Rule(f"p.{i}", "warn", "", patterns=p) for i, p in enumerate(patterns)]
    got = packs.find_in_pack(lines, rules.rules_table(spark, pack))
    key = lambda r: (r.diff_id, r.path, r["at"], r.line, r.rule_id, r.severity, r.start, r.match_text, r.suppressed)
    want = evaluate.find_events(lines, pack[:-1])
    assert Counter(map(key, got.collect())) == Counter(map(key, want.collect()))
    assert got.where("suppressed").count() and got.where("not suppressed").count()
    assert packs.find_in_pack(lines.limit(0), rules.rules_table(spark, pack)).count() == 0
    assert packs.find_in_pack(lines, rules.rules_table(spark, [])).count() == 0
    nothing = spark.createDataFrame([("d", 1, "f", 1, None, "added")], lines.schema)
    assert packs.find_in_pack(nothing, rules.rules_table(spark, pack)).count() == 0


def test_dependencies_in_tables(spark):
    rng = random.Random(13)
    for n, edges in ((1, 0), (6, 6), (12, 20), (20, 12)):
        needs = {f"r{i}": set() for i in range(n)}
        for _ in range(edges):
            needs[f"r{rng.randrange(n)}"].add(f"r{rng.randrange(n)}")
        frame = spark.createDataFrame([(i, sorted(d) or None) for i, d in needs.items()], "id string, depends_on array<string>")
        want = rules.closure([Rule(i, depends_on=tuple(d)) for i, d in needs.items()])
        got = packs.closure_table(frame)
        assert Counter(map(tuple, got.collect())) == Counter((i, d) for i, ds in want.items() for d in ds)
        rows = [(rng.choice("de"), f"f{rng.randrange(4)}", f"r{rng.randrange(n)}", k) for k in range(60)]
        met = {r[:3] for r in rows}
        kept = packs.gate(spark.createDataFrame(rows, "diff_id string, path string, rule_id string, at long"), got)
        assert {r["at"] for r in kept.collect()} == {k for d, f, r, k in rows if all((d, f, x) in met for x in want[r])}
    with pytest.raises(RuleError, match="isn't there"):
        packs.closure_table(spark.createDataFrame([("a", ["b"])], "id string, depends_on array<string>"))


@pytest.mark.parametrize("bits", [(17, 30), (2, 4)])
def test_order_without_a_cap(spark, monkeypatch, bits):
    """Numbers given in blocks are those of one sort, for several diffs, null ones, rules and matches on one line."""
    monkeypatch.setattr(evaluate, "BLOCK_BITS", bits[0])
    monkeypatch.setattr(evaluate, "RANGE_BITS", bits[1])
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), i, "p.txt", i, rng.choice(["x", "y", "x y", "z", "yxx"]), "added") for i in rng.sample(range(400), 150)]
    pack = [Rule("r.y", "warn", "m", patterns=("y",)), Rule("r.x", "info", "m", patterns=("x",))]
    events = evaluate.find_events(spark.createDataFrame(rows, LINES), pack)
    plain = sorted(events.collect(), key=lambda r: (r.at, r.rule_idx, r.start))
    want = {d: [(r.rule_id, r.line) for r in plain if r.diff_id == d] for d in ("a", "b", None)}
    for most in (None, 1 << 40, 1000, 5):
        got = evaluate.findings(events, pack, most).collect()
        for d, own in want.items():
            assert {r.n: (r.rule_id, r.line) for r in got if r.diff_id == d} == dict(enumerate(own[:most], 1))
            assert sum(r.diff_id == d for r in got) == len(own[:most])
    assert evaluate.findings(events.limit(0), pack, None).count() == 0


def test_masked_lines_are_scanned_once(spark):
    rows = [("a.py", 1, "the # hunksieve: ignore-next-line"), ("a.py", 2, "the of"), ("a.py", 3, "of # the"), ("a.rs", 1, "the // hunksieve: ignore w"), ("a.rs", 2, "the")]
    pack = [Rule("w", "info", "", patterns=("the",), ignore_comments=True), Rule("v", "info", "", patterns=("of",))]
    assert found(spark, rows, pack) == [("w", "a.py", 1, 1, "the", "info", False), ("w", "a.py", 2, 1, "the", "info", True), ("v", "a.py", 2, 5, "of", "info", True), ("v", "a.py", 3, 1, "of", "info", False), ("w", "a.rs", 1, 1, "the", "info", True), ("w", "a.rs", 2, 1, "the", "info", False)]
    plan = evaluate.find_events(lines(spark, rows), pack)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("mask_stream") + plan.count("MapInArrow run(") <= 2  # that and the maps of long files


def test_joined_lines_are_searched_once(spark):
    """A step's outcome is a column for the next: two texts are joined, and what several windows see is dropped without a shuffle."""
    rule = Rule("late", "info", "", patterns=(r"a\nb", "c"), multiline=True, multiline_window=3)
    lines = spark.createDataFrame([("d", n, "x.txt", n, c, "added") for n, c in enumerate(("x", "a", "b", "c", "c"))], LINES)
    events = evaluate.find_events(lines, [rule])
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join") == 2
    assert [(r.line, r.start, r.match_text) for r in events.orderBy("at").collect()] == [(1, 0, "a\nb"), (3, 0, "c")]
