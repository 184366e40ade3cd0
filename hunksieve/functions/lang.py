"""Languages: by file extension, by name, and their comment and string syntax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of each language.
EXTENSIONS = {
    "rust": "rs",
    "python": "py pyw",
    "javascript": "js mjs cjs jsx",
    "typescript": "ts mts cts tsx",
    "go": "go",
    "java": "java",
    "kotlin": "kt kts",
    "ruby": "rb rake",
    "c": "c h",
    "cpp": "cc cpp cxx hpp hxx hh",
    "csharp": "cs",
    "shell": "sh bash zsh ksh fish",
    "swift": "swift",
    "scala": "scala sc",
    "sql": "sql",
    "xml": "xml xsl xslt xsd svg xhtml html htm",
    "php": "php phtml php3 php4 php5 php7 phps",
    "yaml": "yaml yml",
    "toml": "toml",
    "json": "json jsonc json5",
}
BY_EXTENSION = {ext: lang for lang, exts in EXTENSIONS.items() for ext in exts.split()}
#: Other names of languages.
ALIASES = {"bash": "shell", "sh": "shell", "zsh": "shell", "ksh": "shell", "fish": "shell", "html": "xml", "xhtml": "xml", "svg": "xml", "xsl": "xml", "xslt": "xml", "yml": "yaml", "jsonc": "json", "json5": "json"}

#: Kinds of comments (all others: c) and of strings (all others: c).
COMMENTS = {"python": "hash", "ruby": "hash", "shell": "hash", "yaml": "hash", "toml": "hash", "rust": "nested", "swift": "nested", "scala": "nested", "sql": "sql", "xml": "xml", "php": "php"}
STRINGS = {"rust": "rust", "python": "python", "javascript": "script", "typescript": "script", "ruby": "script", "go": "go", "shell": "shell", "swift": "swift", "scala": "swift", "sql": "sql", "xml": "xml", "php": "php"}


def parse_language(name: str) -> str:
    """The language of a name in any case; `unknown` for others."""
    name = name.lower()
    name = ALIASES.get(name, name)
    return name if name in EXTENSIONS else "unknown"


def language_of(path: Column) -> Column:
    """Language of a path by its extension, in any case; null without one. A leading dot starts no extension."""
    ext = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    return F.element_at(F.create_map(*(F.lit(x) for pair in BY_EXTENSION.items() for x in pair)), ext)
