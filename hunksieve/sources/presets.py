"""Rules that come with the package."""

from __future__ import annotations

from ..operators.rules import Rule

SCRIPT_PATHS = ("**/*.js", "**/*.ts", "**/*.jsx", "**/*.tsx")
SCRIPT_MODULES = (*SCRIPT_PATHS, "**/*.mjs", "**/*.cjs")
RUST_ASIDE = ("**/tests/**", "**/benches/**", "**/examples/**")
SCRIPT_TESTS = ("**/tests/**", "**/*.test.*", "**/*.spec.*")
SAMPLES = ("**/*.md", "**/docs/**", "**/*.example", "**/*.sample")


def _code(lang: str | tuple[str, ...], paths: tuple[str, ...], id: str, severity: str, message: str, patterns: tuple[str, ...], aside: tuple[str, ...] = (), comments: bool = True) -> Rule:
    """A rule on the code of a language; strings, and mostly comments, don't count."""
    return Rule(id, severity, message, languages=(lang,) if isinstance(lang, str) else lang, patterns=patterns, paths=paths, exclude_paths=aside, ignore_comments=comments, ignore_strings=True)


def _secret(id: str, severity: str, message: str, patterns: tuple[str, ...], aside: tuple[str, ...] = SAMPLES, comments: bool = True) -> Rule:
    return Rule(id, severity, message, patterns=patterns, paths=("**/*",), exclude_paths=aside, ignore_comments=comments)


#: Ids, severities, patterns and paths of the documented built-in rules.
BUILT_IN = [
    _code("go", ("**/*.go",), "go.no_fmt_print", "warn", "fmt printing in production code", (r"\bfmt\.(Print|Println|Printf)\s*\(",), ("**/*_test.go",)),
    _code(("javascript", "typescript"), SCRIPT_PATHS, "js.no_console", "warn", "console logging in production code", (r"\bconsole\.(log|debug|info)\s*\(",), SCRIPT_TESTS),
    _code(("javascript", "typescript"), SCRIPT_PATHS, "js.no_debugger", "error", "debugger statement", (r"\bdebugger\b",)),
    _code("python", ("**/*.py",), "python.no_pdb", "error", "debugger import or call", (r"\bimport\s+pdb\b", r"\bpdb\.set_trace\s*\(")),
    _code("python", ("**/*.py",), "python.no_print", "warn", "print in production code", (r"\bprint\s*\(",), ("**/tests/**", "**/test_*.py")),
    _code("ruby", ("**/*.rb",), "ruby.no_puts", "warn", "printing in production code", (r"\bputs\b", r"\bp\s+[^=]"), ("**/spec/**", "**/test/**")),
    _code("rust", ("**/*.rs",), "rust.no_dbg", "warn", "debug printing in production code", (r"\bdbg!\(", r"\bprintln!\(", r"\beprintln!\("), RUST_ASIDE),
    _code("rust", ("**/*.rs",), "rust.no_unwrap", "error", "unwrap or expect in production code", (r"\.unwrap\(", r"\.expect\("), RUST_ASIDE),
]

RUST, PYTHON, SCRIPT = ("rust", ("**/*.rs",)), ("python", ("**/*.py",)), (("javascript", "typescript"), SCRIPT_MODULES)
MODULES = ("**/node_modules/**",)
TODO = (r"\bTODO\b", r"\bFIXME\b", r"\bHACK\b")

#: Ids, severities, messages, patterns and paths of the presets.
PRESETS: dict[str, list[Rule]] = {
    "minimal": [],
    "rust-quality": [
        _code(*RUST, "rust.no_unwrap", "error", "Avoid unwrap() in production code - use proper error handling.", (r"\.unwrap\(",), RUST_ASIDE),
        _code(*RUST, "rust.no_expect", "warn", "Consider replacing expect() with proper error handling.", (r"\.expect\(",), RUST_ASIDE),
        _code(*RUST, "rust.no_dbg", "error", "Remove dbg!() macro before merging.", (r"\bdbg!\(",), RUST_ASIDE),
        _code(*RUST, "rust.no_println", "warn", "Remove println!/eprintln! before merging - use proper logging.", (r"\bprintln!\(", r"\beprintln!\("), (*RUST_ASIDE, "**/bin/**")),
        _code(*RUST, "rust.no_todo", "warn", "Resolve TODO/FIXME comments before merging.", TODO, (), False),
        _code(*RUST, "rust.no_unimplemented", "error", "Replace unimplemented!()/todo!() with proper implementation.", (r"\bunimplemented!\(", r"\btodo!\("), RUST_ASIDE),
    ],
    "secrets": [
        _secret("secrets.api_key", "error", "Potential API key detected - use environment variables instead.", (r"""(?i)(api[_-]?key|apikey)\s*[=:]\s*['"][^'"]{8,}['"]""", r"""(?i)(api[_-]?key|apikey)\s*=\s*['"][^'"]{8,}['"]""")),
        _secret("secrets.secret_key", "error", "Potential secret key detected - use environment variables instead.", (r"""(?i)(secret[_-]?key|secretkey)\s*[=:]\s*['"][^'"]{8,}['"]""", r"""(?i)(client[_-]?secret)\s*[=:]\s*['"][^'"]{8,}['"]""")),
        _secret("secrets.password", "error", "Potential hardcoded password detected - use environment variables instead.", (r"""(?i)(password|passwd|pwd)\s*[=:]\s*['"][^'"]{4,}['"]""",), (*SAMPLES, "**/*.test.*", "**/tests/**")),
        _secret("secrets.private_key", "error", "Potential private key detected - never commit private keys.", ("-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", "-----BEGIN PGP PRIVATE KEY BLOCK-----"), SAMPLES[:2], False),
        _secret("secrets.aws_credentials", "error", "Potential AWS credentials detected - use IAM roles or environment variables.", (r"""(?i)aws[_-]?(access[_-]?key[_-]?id|secret[_-]?access[_-]?key)\s*[=:]\s*['"][A-Za-z0-9/+=]{16,}['"]""", "AKIA[0-9A-Z]{16}")),
        _secret("secrets.jwt_token", "error", "Potential JWT token detected - tokens should not be committed.", (r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",), (*SAMPLES[:2], "**/tests/**")),
        _secret("secrets.generic_token", "warn", "Potential token or secret detected - review if this should be committed.", (r"""(?i)(token|auth[_-]?token|bearer)\s*[=:]\s*['"][^'"]{20,}['"]""",), (*SAMPLES, "**/tests/**")),
    ],
    "js-console": [
        _code(*SCRIPT, "js.no_console_log", "warn", "Remove console.log() before merging - use a proper logger.", (r"\bconsole\.log\s*\(",), (*SCRIPT_TESTS, *MODULES)),
        _code(*SCRIPT, "js.no_console_debug", "warn", "Remove console.debug() before merging.", (r"\bconsole\.(debug|info|trace)\s*\(",), (*SCRIPT_TESTS, *MODULES)),
        _code(*SCRIPT, "js.no_console_error", "info", "Consider using a proper error logging service instead of console.error().", (r"\bconsole\.(error|warn)\s*\(",), (*SCRIPT_TESTS, *MODULES)),
        _code(*SCRIPT, "js.no_debugger", "error", "Remove debugger statement before merging.", (r"\bdebugger\s*;?",), MODULES),
        _code(*SCRIPT, "js.no_alert", "error", "Remove alert()/confirm()/prompt() before merging.", (r"\b(alert|confirm|prompt)\s*\(",), (*SCRIPT_TESTS, *MODULES)),
        _code(*SCRIPT, "js.no_todo", "warn", "Resolve TODO/FIXME comments before merging.", TODO, MODULES, False),
    ],
    "python-debug": [
        _code(*PYTHON, "python.no_print", "warn", "Remove print() before merging - use proper logging.", (r"\bprint\s*\(",), ("**/tests/**", "**/test_*.py", "**/*_test.py", "**/conftest.py")),
        _code(*PYTHON, "python.no_pdb", "error", "Remove pdb import/usage before merging.", (r"\bimport\s+pdb\b", r"\bfrom\s+pdb\s+import\b", r"\bpdb\.set_trace\s*\(")),
        _code(*PYTHON, "python.no_breakpoint", "error", "Remove breakpoint() before merging.", (r"\bbreakpoint\s*\(",)),
        _code(*PYTHON, "python.no_ipdb", "error", "Remove ipdb import/usage before merging.", (r"\bimport\s+ipdb\b", r"\bfrom\s+ipdb\s+import\b", r"\bipdb\.set_trace\s*\(")),
        _code(*PYTHON, "python.no_pudb", "error", "Remove pudb import/usage before merging.", (r"\bimport\s+pudb\b", r"\bfrom\s+pudb\s+import\b")),
        _code(*PYTHON, "python.no_ic", "warn", "Remove icecream (ic) debugging before merging.", (r"\bfrom\s+icecream\s+import\b", r"\bic\s*\("), ("**/tests/**", "**/test_*.py", "**/*_test.py")),
        _code(*PYTHON, "python.no_todo", "warn", "Resolve TODO/FIXME comments before merging.", TODO, (), False),
    ],
}
