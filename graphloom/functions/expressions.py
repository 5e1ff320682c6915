"""Scalar expressions of the engine, all evaluated by the JVM."""

from __future__ import annotations

import fnmatch
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default patterns of test and generated files, decorators aside.
TEST_PATTERNS = ("test_*", "*_test.py", "tests/", "__tests__/")
GENERATED_PATTERNS = ("*_pb2.py", "*_pb2_grpc.py", "*.generated.*")
STUB_SUFFIXES = (".pyi", ".d.ts")

# Boosts by visibility.
VISIBILITY_BOOST = {"public": 1.0, "protected": 0.97, "internal": 0.94, "private": 0.88}
SECONDARY_PROJECT_BOOST = 0.92

# Boosts by label, when knowledge ranks a little below code, and when it is what is asked for.
LABEL_BOOSTS = {
    "code": {},
    "blended": {"Callable": 1.15, "TypeDef": 1.15, "Module": 1.10, "Value": 1.10, "Package": 1.05, "DocFile": 0.70, "DocSection": 0.70, "Note": 0.70},
    "knowledge": {"Callable": 0.85, "TypeDef": 0.85, "Module": 0.90, "Value": 0.90, "Package": 0.95, "DocFile": 1.10, "DocSection": 1.15, "Note": 1.15},
}


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def last_part(c: Column, sep: str) -> Column:
    return F.substring_index(c, sep, -1)


def glob_regex(pattern: str) -> str:
    """A Java regular expression of a shell glob (``*``, ``?``, ``[...]``)."""
    out = fnmatch.translate(pattern)
    return "(?s)^" + re.sub(r"^\(\?s:(.*)\)\\[Zz]$", r"\1", out).replace("(?>", "(?:") + "$"


def normal_path(path: Column) -> Column:
    """Lower case with forward slashes; null is empty."""
    return F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))


def is_test(path: Column, name: Column, patterns: tuple[str, ...] = TEST_PATTERNS) -> Column:
    """A path below a test folder, a file name that matches a pattern, or a name that says test; case and the kind of slash do not matter."""
    low, named = normal_path(path), F.lower(F.coalesce(name, F.lit("")))
    base = last_part(low, "/")
    tests = [F.concat(F.lit("/"), low, F.lit("/")).contains("/" + p.lower()) if p.endswith("/") else base.rlike(glob_regex(p.lower())) for p in patterns]
    return any_of([*tests, named.startswith("test_") | named.endswith("_test")])


def is_test_qualified(qn: Column, patterns: tuple[str, ...] = TEST_PATTERNS) -> Column:
    """``is_test`` where only a dotted name is known: dots stand for path separators."""
    return is_test(F.replace(qn, F.lit("."), F.lit("/")), last_part(qn, "."), patterns)


def is_stub(path: Column) -> Column:
    return any_of([normal_path(path).endswith(s) for s in STUB_SUFFIXES])


def is_generated(path: Column, patterns: tuple[str, ...] = GENERATED_PATTERNS) -> Column:
    return any_of([last_part(normal_path(path), "/").rlike(glob_regex(p.lower())) for p in patterns])


def matches_any_glob(path: Column, globs: list[str]) -> Column:
    return any_of([path.rlike(glob_regex(g)) for g in globs])


def _hashed(parts: list[Column]) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 16)


def content_hash(
    name: Column, kind: Column, visibility: Column, signature: Column | None = None, docstring: Column | None = None, tags: Column | None = None,
    source: Column | None = None, properties: Column | None = None, rationale: Column | None = None, citations: Column | None = None,
) -> Column:
    """16 hex digits over an entity's meaning: eight parts joined by a zero byte, missing ones empty, and rationale and citations where
    there are any. Places are not part of it, so moved code keeps its hash. ``tags`` and ``citations``: arrays;
    ``properties``: JSON text."""
    text = lambda c: F.lit("") if c is None else F.coalesce(c.cast("string"), F.lit(""))
    listed = lambda c: F.lit("") if c is None else F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    parts = [text(name), text(kind), text(visibility), text(signature), text(docstring), listed(tags), text(source), text(properties)]
    for prefix, found in (("rationale:", text(rationale)), ("citations:", listed(citations))):
        parts.append(F.when(found != "", F.concat(F.lit(prefix), found)))  # a null is left out
    return _hashed(parts)


def file_hash(text: Column, fold_blank_lines: bool = True) -> Column:
    """16 hex digits of the text's lines without trailing white space; runs of blank lines count as one. Any line end will do, and a
    last one makes no difference. ``fold_blank_lines=False``: of the text as it is."""
    if not fold_blank_lines:
        return F.substring(F.sha2(text, 256), 1, 16)
    out = F.regexp_replace(text, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"\n\z", "")
    out = F.regexp_replace(out, r"[ \t\x0b\x0c]+(?=\n|\z)", "")
    return F.substring(F.sha2(F.regexp_replace(out, r"\n{3,}", "\n\n"), 256), 1, 16)


def json_value(text: Column, path: str) -> Column:
    """A scalar of JSON text, by a dotted path; null where there is none."""
    return F.get_json_object(text, f"$.{path}")


def rationale_markers(text: Column) -> Column:
    """Lines that start a rationale, as an array of ``marker: text``."""
    return F.regexp_extract_all(text, F.lit(r"(?m)\b((?:NOTE|WHY|HACK):[^\n]*)"), F.lit(1))


def citation_keys(text: Column) -> Column:
    """Distinct ``SCHEME-number`` keys cited in a text, numbers without leading zeros, sorted."""
    found = F.regexp_extract_all(F.upper(text), F.lit(r"\b((?:ADR|RFC)[ \-_#]?[0-9]{1,6})\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.concat(F.substring(x, 1, 3), F.lit("-"), F.regexp_extract(x, r"([0-9]+)$", 1).cast("int").cast("string")))))


def wikilinks(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)"), F.lit(1)), lambda x: F.trim(x))


def inline_tags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?:^|\s)#([A-Za-z][A-Za-z0-9_/\-]*)"), F.lit(1))


def headings(text: Column) -> Column:
    """(level, title) of each heading line."""
    lines = F.regexp_extract_all(text, F.lit(r"(?m)^(#{1,6} +[^\n]+)$"), F.lit(1))
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_extract(x, "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(x, "^#+ +", "")).alias("title")))


def module_name(path: Column) -> Column:
    """Dotted module name of a source path: leading ``src/``, suffix and ``__init__`` go."""
    out = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:\./)?(?:src/)?", "")
    return F.replace(F.regexp_replace(F.regexp_replace(out, r"\.pyi?$", ""), r"(?:^|/)__init__$", ""), F.lit("/"), F.lit("."))


def name_visibility(name: Column) -> Column:
    """By Python's conventions: names between double underscores are public, others that start with one are private."""
    return F.when(name.startswith("__") & name.endswith("__"), "public").when(name.startswith("_"), "private").otherwise("public")


def is_resource_path(text: Column) -> Column:
    """Looks like a relative path of a data or configuration file, not a URL or a glob."""
    return text.rlike(r"^[\w./\-]+\.(?:json|ya?ml|toml|ini|cfg|conf|csv|tsv|txt|sql|xml|html|env|parquet)$") & ~text.contains("://") & ~text.contains("..")


def anchor_kind(anchor: Column) -> Column:
    """How a note's anchor names its target."""
    target = F.substring_index(anchor, "#", 1)
    return (
        F.when(target.rlike(r"^(?:/|[A-Za-z]:[\\/])"), "absolute")
        .when(target.rlike(r"^[\w\-]+:[\w\-]+/.*"), "project_path")
        .when(target.rlike(r"^[\w\-]+:[^/]+$"), "uid")
        .otherwise("path")
    )


def embed_text(label: Column, kind: Column, name: Column, header_path: Column, docstring: Column, tags: Column, source: Column) -> Column:
    """The text that an entity is embedded by: documents by their trail of headings, notes by title and tags, code by kind and name."""
    doc = F.concat_ws("\n", header_path, docstring)
    note = F.concat_ws("\n", name, F.concat_ws(" ", tags), docstring)
    code = F.concat_ws("\n", F.concat_ws(" ", kind, name), docstring, source)
    return F.when(label == "DocSection", doc).when(label == "Note", note).otherwise(code)


def visibility_boost(visibility: Column) -> Column:
    return reduce(lambda out, kv: F.when(visibility == kv[0], kv[1]).otherwise(out), VISIBILITY_BOOST.items(), F.lit(1.0))


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)
