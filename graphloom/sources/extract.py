"""Extraction: table functions from source text to entities and relationships."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from graphloom.functions.expressions import headings, rationale_markers
from graphloom.sources.languages import LANGUAGES, yaml_keys
from graphloom.sources.rows import ROW

#: Longer sources are not parsed, unless told otherwise; each of them gives a row of kind "skipped".
MAX_BYTES = 1 << 20


def _row(entity="", label="", kind="", name="", rel="", target="", start=0, end=0, doc=None, sig=None):
    return entity, label, kind, name, rel, target, start, end, doc, sig


#: A literal that names a file below a directory or with a suffix: no URL, glob, template or absolute path.
_RESOURCE = re.compile(r"(?![/-])(?!.*//)[A-Za-z0-9_./\\-]{1,200}(?<!/)")


def looks_like_file(text: str) -> bool:
    last = text.replace("\\", "/").rpartition("/")[2]
    return bool(_RESOURCE.fullmatch(text)) and last not in (".", "..") and ("/" in text or re.search(r"\.[A-Za-z0-9_]{1,10}$", last) is not None)


def _names(node: ast.AST | None) -> Iterator[str]:
    """Names in an annotation, those inside quotes too."""
    for x in ast.walk(node) if node is not None else ():
        if isinstance(x, ast.Name):
            yield x.id
        elif isinstance(x, ast.Constant) and isinstance(x.value, str):
            yield from re.findall(r"[A-Za-z_]\w*", x.value)


def _facts_of_call(owner: str, node: ast.Call) -> Iterator[tuple]:
    """What a call reads besides calling: variables of the environment, files, callables that it is handed."""
    target, first = ast.unparse(node.func), node.args[0] if node.args else None
    literal = first.value if isinstance(first, ast.Constant) and isinstance(first.value, str) else None
    if literal and target in ("os.getenv", "os.environ.get", "getenv", "environ.get"):
        yield _row(owner, rel="READS_ENV", target=literal, start=node.lineno)
    if literal and target.rpartition(".")[2] in ("open", "Path", "read_text", "read_csv", "read_json", "read_parquet") and looks_like_file(literal):
        yield _row(owner, rel="REFERENCES_FILE", target=literal, start=node.lineno)
    for a in [*node.args, *(k.value for k in node.keywords)]:
        if isinstance(a, (ast.Name, ast.Attribute)):
            yield _row(owner, rel="REFERENCES", target=ast.unparse(a), start=node.lineno)


def parse_python(module: str, source: str) -> Iterator[tuple]:
    """Classes, functions, imports, bases and calls of a Python module; nothing of one that does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return
    yield _row(module, "Module", "module", module.rsplit(".", 1)[-1], start=1, end=source.count("\n") + 1, doc=ast.get_docstring(tree))
    todo: list[tuple[str, ast.AST, bool]] = [(module, n, False) for n in ast.iter_child_nodes(tree)]
    while todo:
        owner, node, in_class = todo.pop()
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            qn, is_class = f"{owner}.{node.name}", isinstance(node, ast.ClassDef)
            signature = "" if is_class else f"({ast.unparse(node.args)})"
            yield _row(qn, "TypeDef" if is_class else "Callable", "class" if is_class else "method" if in_class else "function", node.name, start=node.lineno, end=node.end_lineno, doc=ast.get_docstring(node), sig=signature)
            yield _row(owner, rel="DEFINES", target=qn, start=node.lineno)
            for d in node.decorator_list:
                if isinstance(d, ast.Call):
                    yield _row(qn, rel="REGISTERED_BY", target=ast.unparse(d.func), start=node.lineno)
            if is_class:
                yield from (_row(qn, rel="INHERITS", target=ast.unparse(b), start=node.lineno) for b in node.bases)
            else:
                a = node.args
                notes = [x.annotation for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg] if x] + [node.returns]
                yield from (_row(qn, rel="USES_TYPE", target=n, start=node.lineno) for n in dict.fromkeys(n for x in notes for n in _names(x)))
            todo += [(qn, n, is_class) for n in node.body]
        elif isinstance(node, ast.Import):
            yield from (_row(module, rel="IMPORTS", target=a.name, start=node.lineno) for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield from (_row(module, rel="IMPORTS", target="." * node.level + ".".join(x for x in (node.module, a.name) if x), start=node.lineno) for a in node.names)
        else:
            if isinstance(node, ast.Call):
                yield _row(owner, rel="CALLS", target=ast.unparse(node.func), start=node.lineno)
                yield from _facts_of_call(owner, node)
            elif isinstance(node, ast.Subscript) and ast.unparse(node.value) in ("os.environ", "environ") and isinstance(node.slice, ast.Constant):
                yield _row(owner, rel="READS_ENV", target=str(node.slice.value), start=node.lineno)
            elif isinstance(node, ast.AnnAssign):
                yield from (_row(owner, rel="USES_TYPE", target=n, start=node.lineno) for n in dict.fromkeys(_names(node.annotation)))
            todo += [(owner, n, in_class) for n in ast.iter_child_nodes(node)]


def parse_sql(name: str, source: str) -> Iterator[tuple]:
    """Tables with columns and foreign keys, views and indexes of a DDL script."""
    text = re.sub(r"--[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)
    line = lambda at: text.count("\n", 0, at) + 1
    ident = r"[\w.\"`\[\]]+"
    clean = lambda s: re.sub(r"[\"`\[\]]", "", s)
    for m in re.finditer(rf"\bCREATE\s+(?:OR\s+(?:REPLACE|ALTER)\s+)?(FUNCTION|PROCEDURE|TRIGGER)\s+({ident})\s*(\([^()]*(?:\([^()]*\)[^()]*)*\))?", text, re.I):
        qn = f"{name}.{clean(m[2])}"
        yield _row(qn, "Callable", f"sql_{m[1].lower()}", clean(m[2]), start=line(m.start()), end=line(m.end()), sig=m[3])
        yield _row(name, rel="DEFINES", target=qn, start=line(m.start()))
    for m in re.finditer(rf"\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?(TABLE|VIEW|(?:UNIQUE\s+)?INDEX)\s+(?:IF\s+NOT\s+EXISTS\s+)?({ident})", text, re.I):
        kind, qn = m[1].upper().split()[-1], f"{name}.{clean(m[2])}"
        end = text.find(";", m.end())
        body = text[m.end() : end if end >= 0 else len(text)]
        yield _row(qn, "Value" if kind == "INDEX" else "TypeDef", f"sql_{kind.lower()}", clean(m[2]), start=line(m.start()), end=line(m.end() + len(body)))
        yield _row(name, rel="DEFINES", target=qn, start=line(m.start()))
        yield from (_row(qn, rel="USES_TYPE", target=clean(t), start=line(m.start())) for t in dict.fromkeys(re.findall(rf"\b(?:REFERENCES|FROM|JOIN|ON)\s+({ident})", body, re.I)) if kind != "INDEX" or not t.startswith("("))
        if kind == "TABLE" and "(" in body:
            depth, part, parts = 0, "", []
            for c in body[body.index("(") + 1 :]:
                depth += (c == "(") - (c == ")")
                if depth < 0:
                    break
                if c == "," and not depth:
                    parts.append(part)
                    part = ""
                else:
                    part += c
            for column in [*parts, part]:
                c = re.match(rf"\s*({ident})\s+\w+", column)
                if c and clean(c[1]).upper() not in ("PRIMARY", "FOREIGN", "CONSTRAINT", "UNIQUE", "CHECK", "KEY", "INDEX"):
                    yield _row(f"{qn}.{clean(c[1])}", "Value", "sql_column", clean(c[1]), start=line(m.start()))
                    yield _row(qn, rel="DEFINES", target=f"{qn}.{clean(c[1])}", start=line(m.start()))


# How sure a mention in a document is, by what it looks like; the suffixes of files that a text may name; the shortest name.
LINK_CONFIDENCE = {"explicit": 0.9, "file_ref": 0.85, "symbol_mention": 0.8}
CODE_SUFFIXES = "py|pyi|js|ts|jsx|tsx|java|go|rs|rb|cpp|c|h|hpp|md"
LEAST_NAME = 3


def _mentions(line: str) -> Iterator[tuple[str, str]]:
    """(kind of link, target) of the symbols in back-ticks and of the paths that a line names."""
    for m in re.finditer(r"`([A-Za-z_][\w.]*)(?:\(\))?`", line):
        yield "symbol_mention", m[1]
    for m in re.finditer(rf"(?<!\w)([\w./\\-]+\.(?:{CODE_SUFFIXES}))(?!\w)", line):
        if "/" in m[1].replace("\\", "/"):
            yield "file_ref", m[1].replace("\\", "/")


def parse_markdown(name: str, source: str) -> Iterator[tuple]:
    """Sections by heading, wiki links, and mentions of code and files, of which ``kind`` tells what they look like. Front matter makes a note of a
    document: its anchors, what it derives from and what it supersedes."""
    front, body, first = "", source, 1
    if m := re.match(r"---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)", source, re.S):
        front, body, first = m[1], source[m.end() :], source[: m.end()].count("\n") + 1
    title, links = name.rsplit("/", 1)[-1], []
    for line, path, value in yaml_keys(front):
        if path[1:] == ["title"] and value:
            title = value
        if len(path) > 1 and value and (rel := {"anchors": "DOCUMENTS", "derived_from": "DERIVED_FROM", "supersedes": "SUPERSEDES", "links": "LINKS_TO"}.get(path[1])):
            links += [_row(name, kind="anchor" if rel == "DOCUMENTS" else "", rel=rel, target=re.sub(r"^\[\[|\]\]$", "", t.strip().strip("'\"")), start=line + 1) for t in (value.strip("[]").split(",") if value.startswith("[") and not value.startswith("[[") else [value])]
    yield _row(name, "Note" if front else "DocFile", "note" if front else "doc", title, start=1, end=source.count("\n") + 1)
    yield from links
    trail: list[tuple[int, str]] = []
    owner, fenced = name, False
    for number, line in enumerate(body.split("\n"), first):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        if fenced:
            continue
        if m := re.match(r"(#{1,6})\s+(.+?)\s*#*$", line):
            trail = [t for t in trail if t[0] < len(m[1])]
            parent = name if not trail else f"{name}#" + "/".join(t[1] for t in trail)
            trail.append((len(m[1]), m[2]))
            owner = f"{name}#" + "/".join(t[1] for t in trail)
            yield _row(owner, "DocSection", "section", m[2], start=number)
            yield _row(parent, rel="CONTAINS", target=owner, start=number)
            if len(m[1]) > 1 and len(m[2]) >= LEAST_NAME and re.fullmatch(r"[A-Z][a-zA-Z0-9]*(?:[A-Z][a-z0-9]+)+|[a-z][a-z0-9]*(?:_[a-z0-9]+)+", m[2]):
                yield _row(owner, kind="explicit", rel="DOCUMENTS", target=m[2], start=number)
        yield from (_row(owner, rel="LINKS_TO", target=t.strip(), start=number) for t in re.findall(r"\[\[([^\]|#]+)", line))
        yield from (_row(owner, kind=kind, rel="DOCUMENTS", target=t, start=number) for kind, t in dict.fromkeys(_mentions(line)))


PARSERS = {**LANGUAGES, ".py": parse_python, ".pyi": parse_python, ".sql": parse_sql, ".md": parse_markdown}


def register_language(suffix: str, parse) -> None:
    """``parse(name, source)`` for files of a suffix, or of a whole name."""
    PARSERS[suffix] = parse


def load_plugins(group: str = "graphloom.languages") -> list[str]:
    """Register the parsers that installed packages offer as entry points named by suffix; gives the suffixes."""
    from importlib.metadata import entry_points

    found = {e.name: e.load() for e in entry_points(group=group)}
    PARSERS.update(found)
    return sorted(found)


def suffix_of(path: str) -> str:
    """The key of a path's parser: its whole name, a long ending, or its suffix."""
    base = path.rpartition("/")[2]
    if base in PARSERS:
        return base
    if base.split(".")[0] in ("Dockerfile", "Containerfile"):
        return base.split(".")[0]
    return "-meta.xml" if base.endswith("-meta.xml") else "." + base.rpartition(".")[2]


def parse_source(name: str, suffix: str, source: str | None, max_bytes: int, parsers: dict) -> Iterator[tuple]:
    """The rows of one source. One that is too long or does not parse gives a single row, of kind "skipped" or "unparsed"."""
    parse = parsers.get(suffix)
    if parse is None or source is None:
        return
    if len(source.encode()) > max_bytes:
        yield _row(name, kind="skipped", name=f"over {max_bytes} bytes")
        return
    try:
        rows = list(parse(name, source))
    except (ValueError, SyntaxError, RecursionError) as error:
        rows = [_row(name, kind="unparsed", name=type(error).__name__)]
    yield from rows


@udtf(returnType=ROW)
class ParseSource:
    def eval(self, name: str, suffix: str, source: str):
        yield from parse_source(name, suffix, source, MAX_BYTES, PARSERS)


def register(spark: SparkSession) -> None:
    """``parse_source(name, suffix, text)`` as a table function of SQL."""
    spark.udtf.register("parse_source", ParseSource)


def extracted(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Entities (label set) and relationships (rel_type set) of files. ``files``: name, suffix, text. Sources over ``max_bytes`` and broken ones
    give a row of kind "skipped" or "unparsed"."""
    parsers = dict(PARSERS)

    def run(batches):
        import pyarrow as pa

        types = [pa.string()] * 6 + [pa.int32()] * 2 + [pa.string()] * 2
        names = ["name_in", *(c.split()[0] for c in ROW.split(", "))]
        for b in batches:
            rows = [(n, *r) for n, s, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for r in parse_source(n, s, t, max_bytes, parsers)]
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 11, [pa.string(), *types], strict=True)], names=names)

    return files.select("name", "suffix", "text").mapInArrow(run, f"name_in string, {ROW}").withColumnRenamed("name_in", "file")


def rationale_owners(entities: DataFrame, comments: DataFrame) -> DataFrame:
    """(uid, file_path, line, text): each rationale comment and the smallest entity whose lines hold it, or, of that entity's own lines, the one
    nested in it that starts on the next line. ``entities``: uid, file_path, line_start, line_end; ``comments``: file_path, line, text. The join is on the
    file, then on the span."""
    held = F.col("line").between(F.col("line_start"), F.col("line_end"))
    pairs = comments.join(entities, "file_path").where(held | (F.col("line_start") == F.col("line") + 1))
    w = Window.partitionBy("file_path", "line", "text").orderBy(held, F.col("line_end") - F.col("line_start"), F.desc("line_start"), "uid")
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("uid", "file_path", "line", "text")


def text_facts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its headings and rationale markers."""
    return docs.withColumn("headings", headings(F.col(text))).withColumn("rationale", rationale_markers(F.col(text)))
