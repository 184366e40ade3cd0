"""Quick fixes of documents, and the commands behind them."""

import pytest

from hunksieve.operators.rules import Rule, RuleError
from hunksieve.sinks import actions

MARKS = "diff_id string, path string, line int, start_char int, message string, code string"
NAMED = "id string, url string, code string"


def offers(spark, marks, rules):
    rows = actions.code_actions(spark.createDataFrame(marks, MARKS), spark.createDataFrame(rules, NAMED)).collect()
    return [(r.path, r.at, r.title.split(": ")[1], r.arguments) for r in sorted(rows, key=lambda r: (str(r.path), r.at))]


def test_code_actions(spark):
    marks = [("d", "a", 3, 0, "m", "r.two"), ("d", "a", 1, 4, "m", "r.one"), ("d", "a", 1, 4, "b", "r.none"), ("d", "a", 9, 0, "m", "r.one")]
    marks += [("d", "b", 5, 1, "m", "gone"), ("d", "b", 0, 0, "m", None), ("d", None, 0, 0, None, "r.one")]
    rules = [("r.one", "u1", "x"), ("r.two", "u1", "x"), ("r.none", None, "x"), ("r.other", "u2", "x")]
    want = [("a", 0, "Explain r.none", ["r.none"]), ("a", 1, "Explain r.one", ["r.one"]), ("a", 2, "Open docs for r.one", ["u1", "r.one"]), ("a", 3, "Explain r.two", ["r.two"]), ("b", 0, "Explain gone", ["gone"])]
    assert offers(spark, marks[:-1], rules) == offers(spark, marks[:-1] * 3, rules) == want
    assert offers(spark, marks[-1:], rules) == [(None, 0, "Explain r.one", ["r.one"]), (None, 1, "Open docs for r.one", ["u1", "r.one"])]
    assert offers(spark, [], rules) == [] and len(offers(spark, marks, [])) == 5


def test_commands(spark):
    rules = [Rule("r.one", "warn", "first", patterns=("a",)), Rule("r.two", "error", "second", patterns=("b",))]
    run = lambda *args, **how: actions.execute(spark, *args, **how)
    told = run(actions.EXPLAIN, ["r.two"], rules)
    assert told["found"] and told["message"].startswith("Rule: r.two\nSeverity: error\nMessage: second")
    assert run(actions.EXPLAIN, ["R.TWO.X"], rules) == {"ruleId": "R.TWO.X", "found": False, "message": "Rule 'R.TWO.X' not found.\nDid you mean:\n- r.two"}
    assert run(actions.EXPLAIN, ["zzzzzzzz"], rules)["message"] == run(actions.EXPLAIN, ["zzzzzzzz"], [])["message"] == "Rule 'zzzzzzzz' not found."
    assert run(actions.OPEN_DOCS, ["http://x", "r.one"], [])["message"].endswith("rule r.one: http://x")
    assert run(actions.OPEN_DOCS, ["http://x"], [])["message"].endswith("documentation: http://x")
    assert run(actions.RELOAD, [], rules, reload=lambda: rules[:1]) == {"ok": True, "message": "configuration reloaded", "rules": 1}

    def broken():
        raise RuleError("rule x: unknown fields")

    assert run(actions.RELOAD, [], rules, reload=broken) == {"ok": False, "message": "rule x: unknown fields", "rules": 2}
    for command, arguments in ((actions.EXPLAIN, []), (actions.OPEN_DOCS, [None]), ("other", ["x"])):
        with pytest.raises(ValueError):
            run(command, arguments, rules)
