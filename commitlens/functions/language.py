"""File language, text/binary type and vendored paths.

The reference asks an external classifier; we re-express it as three literal
lookups (file name, extension, shebang interpreter) folded into one map
expression, so classification is a projection inside whole-stage codegen with
no join and no Python.  The table is our own selection from the public
Linguist language list; names are lower-cased as the reference emits them.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identity import base_name

# Language by extension (lower-case extension -> lower-case Linguist name)
LANGUAGE_BY_EXTENSION = {
    ".bat": "batchfile", ".cmd": "batchfile",
    ".c": "c", ".h": "c",
    ".cs": "c#",
    ".cc": "c++", ".cpp": "c++", ".cxx": "c++", ".hh": "c++", ".hpp": "c++", ".hxx": "c++",
    ".clj": "clojure", ".cljs": "clojure",
    ".cmake": "cmake",
    ".css": "css",
    ".csv": "csv",
    ".pyx": "cython",
    ".dart": "dart",
    ".dockerfile": "dockerfile",
    ".ex": "elixir", ".exs": "elixir",
    ".erl": "erlang",
    ".fs": "f#",
    ".go": "go",
    ".gradle": "gradle",
    ".groovy": "groovy",
    ".hs": "haskell",
    ".html": "html", ".htm": "html",
    ".ini": "ini", ".cfg": "ini",
    ".java": "java",
    ".js": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".mjs": "javascript",
    ".json": "json",
    ".jl": "julia",
    ".ipynb": "jupyter notebook",
    ".kt": "kotlin", ".kts": "kotlin",
    ".less": "less",
    ".lua": "lua",
    ".mk": "makefile",
    ".md": "markdown", ".markdown": "markdown",
    ".m": "objective-c",
    ".mm": "objective-c++",
    ".ml": "ocaml",
    ".pl": "perl", ".pm": "perl",
    ".php": "php",
    ".ps1": "powershell",
    ".proto": "protocol buffer",
    ".py": "python", ".pyi": "python", ".pyw": "python",
    ".r": "r",
    ".rst": "restructuredtext",
    ".rb": "ruby",
    ".rs": "rust",
    ".sql": "sql",
    ".scala": "scala",
    ".scss": "scss",
    ".sh": "shell", ".bash": "shell", ".zsh": "shell",
    ".svg": "svg",
    ".swift": "swift",
    ".toml": "toml",
    ".tex": "tex",
    ".txt": "text",
    ".tsx": "tsx",
    ".ts": "typescript",
    ".vue": "vue",
    ".xml": "xml",
    ".yml": "yaml", ".yaml": "yaml",
}

# Language by exact file name
LANGUAGE_BY_FILENAME = {
    "CMakeLists.txt": "cmake",
    "Dockerfile": "dockerfile",
    "Makefile": "makefile", "GNUmakefile": "makefile", "makefile": "makefile",
    "Gemfile": "ruby", "Rakefile": "ruby",
}

# Language by shebang interpreter
LANGUAGE_BY_INTERPRETER = {
    "bash": "shell", "sh": "shell", "zsh": "shell",
    "node": "javascript", "nodejs": "javascript",
    "perl": "perl",
    "php": "php",
    "python": "python", "python2": "python", "python3": "python",
    "ruby": "ruby",
}

# Image extensions (classified as images, not text)
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif")

# Vendored / generated path patterns
VENDORED_PATTERNS = (
    r"(^|/)vendors?/",
    r"(^|/)node_modules/",
    r"(^|/)bower_components/",
    r"(^|/)third[-_]?party/",
    r"(^|/)3rd[-_]?party/",
    r"(^|/)extern(al)?/",
    r"(^|/)dist/",
    r"\.min\.(js|css)$",
    r"(^|/)jquery[^/]*\.js$",
    r"(^|/)bootstrap[^/]*\.(js|css)$",
)


def _vendored_regex() -> str:
    """Any of the patterns; those that start at a name have that start in common, so most places of a path are told by one character."""
    start = "(^|/)"
    named = "|".join(p.removeprefix(start) for p in VENDORED_PATTERNS if p.startswith(start))
    return "|".join([f"(?:^|/)(?:{named})", *[p for p in VENDORED_PATTERNS if not p.startswith(start)]])


VENDORED_REGEX = _vendored_regex()


def _map(d: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in sorted(d.items())))


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def extension(path: str | Column) -> Column:
    """Lower-case ``.ext`` of the base name, null when the name has no dot."""
    name = base_name(path)
    return F.when(F.instr(name, ".") > 0, F.lower(F.concat(F.lit("."), F.substring_index(name, ".", -1))))


def _shebang_language(text: Column) -> Column:
    first = F.substring_index(text, "\n", 1)
    prog = F.regexp_extract(first, r"^#!\s*\S*/([^/\s]+)", 1)
    env_arg = F.regexp_extract(first, r"^#!\s*\S*/env\s+(?:-\S+\s+)*([^\s]+)", 1)
    interp = F.when(prog == F.lit("env"), env_arg).otherwise(prog)
    return F.element_at(_map(LANGUAGE_BY_INTERPRETER), interp)


def detected_language(path: str | Column, text: str | Column | None = None) -> Column:
    """Lower-case language from file name, extension, then shebang; null when unknown."""
    name = base_name(path)
    by_name = F.element_at(_map(LANGUAGE_BY_FILENAME), name)
    by_ext = F.element_at(_map(LANGUAGE_BY_EXTENSION), extension(path))
    if text is None:
        return F.coalesce(by_name, by_ext)
    return F.coalesce(by_name, by_ext, _shebang_language(_col(text)))


def file_type(path: str | Column, text: str | Column | None = None, binary: str | Column | None = None) -> Column:
    """``Image``, ``Binary`` (a NUL anywhere) or ``Text``."""
    is_image = extension(path).isin(*IMAGE_EXTENSIONS)
    if binary is not None:
        has_nul = F.contains(_col(binary), F.lit(b"\x00"))
    elif text is not None:
        has_nul = F.contains(_col(text), F.lit("\u0000"))
    else:
        has_nul = F.lit(False)
    return F.when(is_image, "Image").when(F.coalesce(has_nul, F.lit(False)), "Binary").otherwise("Text")


def is_vendored(path: str | Column) -> Column:
    return _col(path).rlike(VENDORED_REGEX)


def programming_language(path: str | Column, text: str | Column | None = None,
                         binary: str | Column | None = None) -> Column:
    """Language kept for analysis: text, not vendored, known language; else null."""
    lang = detected_language(path, text)
    keep = (file_type(path, text, binary) == F.lit("Text")) & ~is_vendored(path)
    return F.when(keep, lang)


def blob_language_facts(text: str | Column) -> list[Column]:
    """Per-blob facts the classifier needs, as narrow columns: ``_has_nul``, ``_shebang_lang``."""
    t = _col(text)
    return [
        F.coalesce(F.contains(t, F.lit("\u0000")), F.lit(False)).alias("_has_nul"),
        _shebang_language(t).alias("_shebang_lang"),
    ]


def language_by_name(path: str | Column) -> Column:
    """The language that a file's name settles; null where only its content can tell."""
    return F.coalesce(F.element_at(_map(LANGUAGE_BY_FILENAME), base_name(path)), F.element_at(_map(LANGUAGE_BY_EXTENSION), extension(path)))


def language_of_text(path: str | Column, has_nul: str | Column, shebang_lang: str | Column) -> Column:
    """``programming_language`` from precomputed blob facts, of a path that is known to be neither vendored nor an image."""
    return F.when(~_col(has_nul), F.coalesce(language_by_name(path), _col(shebang_lang)))
