"""Extraction for languages without a parser at hand: a scanner over text whose comments and strings are blanked.

``Scanner`` finds declarations by patterns, gives each the span of its braces, and nests them by span: the innermost
declaration around a place owns what stands there. A language is a ``Grammar``: how comments and strings look, which patterns declare
types and callables, and how imports and bases are written. Names are qualified by the file's and the owners'.
"""

from __future__ import annotations

import bisect
import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from graphloom.sources.rows import entity, relation

C_COMMENTS = r"//[^\n]*|/\*.*?\*/"
C_STRINGS = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
#: Words before a bracket that are no call in any of these languages.
NO_CALLS = frozenset(
    "if for while switch catch return function sizeof typeof new throw super this await yield foreach using lock fixed when elif case match fn func def in and or not print echo isset empty unset array list "
    "decltype alignof static_cast dynamic_cast reinterpret_cast const_cast defined assert do else try class interface enum struct import export default delete void async".split()
)
#: Words that no declaration is named by.
CONTROL = frozenset("if for while switch catch return else do try foreach match function lock using fixed when elif throw".split())


@dataclass(frozen=True)
class Grammar:
    comments: str = C_COMMENTS
    strings: str = C_STRINGS
    #: (pattern with groups ``name`` and maybe ``kind``, kind) of types; of callables; of callables inside a type.
    types: tuple[tuple[str, str], ...] = ()
    callables: tuple[tuple[str, str], ...] = ()
    members: tuple[tuple[str, str], ...] = ()
    #: Patterns with a group 1: what is imported. They see strings, not comments.
    imports: tuple[str, ...] = ()
    #: (relationship, name) pairs of the text between a type's name and its body.
    bases: Callable[[str], Iterator[tuple[str, str]]] = lambda header: iter(())
    calls: str = r"(?<![\w.])([A-Za-z_$][\w$]*(?:(?:\.|::|->|\?\.)[A-Za-z_$][\w$]*)*)\s*\("
    modifiers: str = ""


def _listed(text: str) -> list[str]:
    """Names of a comma list, without type arguments."""
    flat, depth = [], 0
    for c in text:
        depth += (c in "<([") - (c in ">)]")
        flat.append(c if depth <= 0 and c not in ">)]" else " ")
    return [m[0] for part in "".join(flat).split(",") if (m := re.search(r"[A-Za-z_$\\][\w$.:\\]*", re.sub(r"\b(?:public|private|protected|virtual|where)\b.*?(?=[A-Z])|\bvirtual\b", "", part)))]


def worded_bases(header: str) -> Iterator[tuple[str, str]]:
    for word, rel in (("extends", "INHERITS"), ("implements", "IMPLEMENTS")):
        if m := re.search(rf"\b{word}\b(.*?)(?=\bextends\b|\bimplements\b|\bpermits\b|$)", header, re.S):
            yield from ((rel, n) for n in _listed(m[1]))


def colon_bases(header: str) -> Iterator[tuple[str, str]]:
    """After a colon, as in C++ and C#: names that look like interfaces (I and a capital) are implemented."""
    if ":" in header:
        yield from (("IMPLEMENTS" if re.match(r"I[A-Z]", n.rpartition(".")[2]) else "INHERITS", n) for n in _listed(re.split(r"\bwhere\b", header.partition(":")[2])[0]))


def base_classes(header: str) -> Iterator[tuple[str, str]]:
    if ":" in header:
        for part in header.partition(":")[2].split(","):
            if m := re.search(r"([A-Za-z_][\w:]*)\s*(?:<.*)?$", re.sub(r"\b(?:public|private|protected|virtual)\b", " ", part).strip(), re.S):
                yield "INHERITS", m[1]


#: Where a declaration may begin: a line, or what follows another one.
BEGIN = r"(?m)(?:^|(?<=[{};]))[ \t]*"
_TYPED = BEGIN + r"(?:@\w+(?:\([^()]*\))?\s+)*(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|async|sealed|synchronized|native|default|global|webservice|testmethod|partial|extern|unsafe|readonly|new|with|without|sharing|transient)\s+)*"
_JAVA_TYPES = ((r"\b(?P<kind>class|interface|enum|record|struct)\s+(?P<name>[A-Za-z_]\w*)", ""), (r"@interface\s+(?P<name>\w+)", "annotation"))
_JAVA_MEMBERS = (
    (_TYPED + r"(?P<name>[A-Z]\w*)\s*\([^;{}]*?\)\s*(?:throws\s+[\w.,\s]+|:\s*(?:base|this)\s*\([^{}]*\))?(?=\{)", "constructor"),
    (_TYPED + r"(?:<[^<>{};]*>\s+)?[A-Za-z_][\w.]*(?:<[^;{}()]*>)?(?:\[\])*\??\s+(?P<name>[A-Za-z_]\w*)\s*(?:<[^;{}()]*>)?\s*\([^;{}]*?\)\s*(?:throws\s+[\w.,\s]+|where\s+[^{;]+)?(?=\{|;|=>)", "method"),
)
GRAMMARS = {
    "javascript": Grammar(
        strings=C_STRINGS + r"|`(?:\\.|[^`\\])*`",
        types=((r"\bclass\s+(?P<name>[A-Za-z_$][\w$]*)", "class"), (r"(?m)^\s*(?:export\s+)?(?:declare\s+)?interface\s+(?P<name>\w+)", "interface"), (r"(?m)^\s*(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(?P<name>\w+)", "enum"), (r"(?m)^\s*(?:export\s+)?(?:declare\s+)?type\s+(?P<name>\w+)(?:<[^=]*>)?\s*=", "type_alias")),
        callables=((r"\bfunction\s*\*?\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^()]*>)?\(", "function"), (r"\b(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[A-Za-z_$][\w$]*)\s*(?::[^=\n]+?)?=>", "function")),
        members=((BEGIN + r"(?:(?:public|private|protected|static|async|override|abstract|readonly|get|set)\s+)*\*?(?P<name>#?[A-Za-z_$][\w$]*)\s*(?:<[^()]*>)?\([^;{}]*\)\s*(?::[^{};=]+)?(?=\{)", "method"),),
        imports=(r"\bimport\s+(?:[^'\";]*?\bfrom\s*)?['\"]([^'\"]+)['\"]", r"\b(?:require|import)\s*\(\s*['\"]([^'\"]+)['\"]", r"\bexport\s+[^'\";]*?\bfrom\s*['\"]([^'\"]+)['\"]"),
        bases=worded_bases,
    ),
    "java": Grammar(types=_JAVA_TYPES, members=_JAVA_MEMBERS, imports=(r"(?m)(?:^|(?<=;))\s*import\s+(?:static\s+)?([\w.*]+)\s*;",), bases=worded_bases),
    "csharp": Grammar(types=_JAVA_TYPES[:1], members=_JAVA_MEMBERS, imports=(r"(?m)(?:^|(?<=;))\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;",), bases=colon_bases),
    "cpp": Grammar(
        types=((r"\b(?P<kind>class|struct|union|enum)\s+(?:class\s+)?(?P<name>[A-Za-z_]\w*)(?=\s*(?:final\s*)?(?::[^:;{]|\{))", ""),),
        callables=((r"(?m)(?:^|(?<=[{};:]))[ \t]*(?!return\b|else\b|new\b|delete\b|throw\b)(?:template\s*<[^>]*>\s*)?(?:[A-Za-z_][\w:<>,*&\s]*?[\s*&])??(?P<name>(?:[A-Za-z_]\w*::)*~?[A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:const|noexcept|override|final|\s)*(?::[^;{}]*(?:\([^()]*\)|\{[^{}]*\})[^;{}]*)?(?=\{)", "function"),),
        imports=(r"(?m)^\s*#\s*(?:include|import)\s*[<\"]([^>\"]+)[>\"]",), bases=base_classes,
    ),
    "go": Grammar(
        strings=C_STRINGS + r"|`[^`]*`", types=((r"(?m)^\s*(?:type\s+)?(?P<name>[A-Za-z_]\w*)(?:\[[^\]]*\])?\s+(?P<kind>struct|interface)\s*(?=\{)", ""), (r"(?m)^type\s+(?P<name>\w+)\s+(?!struct\b|interface\b)[\w.\[\]*]+", "type_alias")),
        callables=((r"(?m)^func\s*(?:\(\s*(?:\w+\s+)?\*?(?P<owner>\w+)[^)]*\)\s*)?(?P<name>\w+)\s*[(\[]", "function"),), imports=(r"(?m)^\s*import\s+(?:[\w.]+\s+)?\"([^\"]+)\"",),
    ),
    "rust": Grammar(
        strings=r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'", types=((r"\b(?P<kind>struct|enum|trait|union)\s+(?P<name>[A-Za-z_]\w*)", ""), (r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<name>\w+)", "type_alias")),
        callables=((r"\bfn\s+(?P<name>[A-Za-z_]\w*)", "function"),), imports=(r"(?m)(?:^|(?<=[;{}]))\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", r"(?m)^\s*extern\s+crate\s+(\w+)", r"(?m)(?:^|(?<=[;{}]))\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;"),
        calls=r"(?<![\w.])([A-Za-z_]\w*(?:(?:\.|::)[A-Za-z_]\w*)*)!?\s*(?:::<[^()]*>)?\(",
    ),
    "php": Grammar(
        comments=C_COMMENTS + r"|#(?!\[)[^\n]*", types=((r"\b(?P<kind>class|interface|trait|enum)\s+(?P<name>[A-Za-z_]\w*)", ""),), callables=((r"\bfunction\s+&?(?P<name>[A-Za-z_]\w*)\s*\(", "function"),),
        imports=(r"(?m)(?:^|(?<=[;{]))\s*use\s+(?:function\s+|const\s+)?\\?([\w\\]+)[^;{]*;", r"\b(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"]"), bases=worded_bases, calls=r"(?<![\w$])((?:\$?[A-Za-z_]\w*(?:->|::))*[A-Za-z_]\w*)\s*\(",
    ),
}
GRAMMARS["apex"] = GRAMMARS["java"]
KIND_NAMES = {"struct": "struct", "record": "record", "trait": "trait", "union": "union"}


@dataclass
class Declaration:
    qn: str
    label: str
    kind: str
    name: str
    start: int
    body: int
    end: int
    header: str = ""


@dataclass
class Scanner:
    module: str
    source: str
    grammar: Grammar
    found: list[Declaration] = field(default_factory=list)

    def __post_init__(self):
        blank = lambda m: re.sub(r"[^\n]", " ", m[0])
        strings = re.compile(f"(?P<c>{self.grammar.comments})|(?P<s>{self.grammar.strings})", re.S)
        self.code = strings.sub(lambda m: blank(m) if m["c"] else m[0], self.source)
        self.bare = strings.sub(lambda m: blank(m) if m["c"] else m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1] if len(m[0]) > 1 else m[0], self.source)
        self.lines = [0, *(m.end() for m in re.finditer("\n", self.source))]
        self.close, stack = {}, []
        for m in re.finditer(r"[{}]", self.bare):
            if m[0] == "{":
                stack.append(m.start())
            elif stack:
                self.close[stack.pop()] = m.start()

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.lines, at)

    def span(self, at: int) -> tuple[int, int]:
        """(start of the body, end) of a declaration whose header goes on at ``at``: its braces, an expression after an arrow, or nothing
        before a semicolon."""
        depth, arrow = 0, at if self.bare[at - 2 : at] == "=>" else None
        for m in re.compile(r"[{};()\[\]\n]|=>").finditer(self.bare, at):
            c = m[0]
            if arrow is None and depth <= 0 and c == "=>":
                arrow = m.end()
            elif depth <= 0 and c == "{" and (arrow is None or not self.bare[arrow : m.start()].strip()):
                return m.start(), self.close.get(m.start(), len(self.bare))
            elif depth <= 0 and (c == ";" or arrow is not None and c in "}\n" and self.bare[arrow : m.start()].strip()):
                return m.start() if arrow is None else arrow, m.start()
            depth += (c in "([{") - (c in ")]}")
        return len(self.bare), len(self.bare)

    def signature(self, at: int) -> str:
        """The balanced brackets that open next, as one line."""
        start, depth = self.bare.find("(", at), 0
        for m in re.compile(r"[()]").finditer(self.bare, max(start, 0)) if start >= 0 else ():
            depth += 1 if m[0] == "(" else -1
            if not depth:
                return " ".join(self.code[start : m.end()].split())
        return ""

    def around(self, at: int, label: str | None = None) -> Declaration | None:
        """The innermost declaration whose body holds a place."""
        best = None
        for d in self.found:
            if d.start < at and d.body <= at <= d.end and (label is None or d.label == label) and (best is None or d.body >= best.body):
                best = d
        return best

    def declare(self) -> None:
        g, starts = self.grammar, set()
        for patterns, label, inside in ((g.types, "TypeDef", False), (g.callables, "Callable", False), (g.members, "Callable", True)):
            for pattern, kind in patterns:
                for m in re.finditer(pattern, self.bare):
                    name, groups = m["name"], m.groupdict()
                    if m.start("name") in starts or name in CONTROL:
                        continue
                    owner = self.around(m.start("name"))
                    if inside and (owner is None or owner.label != "TypeDef") or kind == "constructor" and owner.name != name:
                        continue
                    body, end = self.span(m.end() if m[0].endswith("=>") else m.end("name"))
                    k = groups.get("kind") or kind
                    above = groups.get("owner") or ("::" in name and name.rpartition("::")[0].replace("::", "."))
                    name = name.rpartition("::")[2]
                    if label == "Callable" and (above or owner is not None and owner.label == "TypeDef") and k == "function":
                        k = "method"
                    prefix = f"{self.module}.{above}" if above else owner.qn if owner else self.module
                    starts.add(m.start("name"))
                    self.found.append(Declaration(f"{prefix}.{name}", label, k, name, m.start("name"), body, end, self.bare[m.end("name") : body]))

    def rows(self) -> Iterator[tuple]:
        g = self.grammar
        self.declare()
        yield entity(self.module, "Module", "module", self.module.rpartition(".")[2] or self.module, 1, len(self.lines))
        for d in sorted(self.found, key=lambda d: d.start):
            yield entity(d.qn, d.label, d.kind, d.name, self.line(d.start), self.line(d.end), signature=self.signature(d.start) if d.label == "Callable" else "")
            yield relation(d.qn.rpartition(".")[0], "DEFINES", d.qn, self.line(d.start))
            if d.label == "TypeDef":
                yield from (relation(d.qn, rel, name, self.line(d.start)) for rel, name in g.bases(d.header))
        for pattern in g.imports:
            yield from (relation(self.module, "IMPORTS", m[1].strip(), self.line(m.start())) for m in re.finditer(pattern, self.code))
        names = {d.start for d in self.found}
        for m in re.finditer(g.calls, self.bare):
            last = re.split(r"\.|::|->|\?\.", m[1])[-1]
            at = m.start(1) + len(m[1]) - len(last)
            within = self.around(m.start())
            if last not in NO_CALLS and at not in names and m.start(1) not in names and (within is None or within.label != "TypeDef"):
                owner = self.around(m.start(), "Callable")
                yield relation(owner.qn if owner else self.module, "CALLS", re.sub(r"->|::|\?\.", ".", m[1]).lstrip("$"), self.line(m.start()))


def scanned(language: str) -> Callable[[str, str], Iterator[tuple]]:
    def parse(module: str, source: str) -> Iterator[tuple]:
        yield from Scanner(module, source, GRAMMARS[language]).rows()

    parse.__name__ = f"parse_{language}"
    return parse


def parse_go(module: str, source: str) -> Iterator[tuple]:
    """Go: also grouped imports, embedded types, and the types that fields name."""
    s = Scanner(module, source, GRAMMARS["go"])
    yield from s.rows()
    for block in re.finditer(r"(?m)^import\s*\((.*?)^\)", s.code, re.S):
        yield from (relation(module, "IMPORTS", m[1], s.line(block.start(1) + m.start())) for m in re.finditer(r"\"([^\"]+)\"", block[1]))
    for d in s.found:
        if d.label == "TypeDef" and d.kind in ("struct", "interface"):
            for m in re.finditer(r"(?m)^[ \t]*(?:(?P<e>\*?[A-Za-z_][\w.]*)|\w+(?:\s*,\s*\w+)*[ \t]+(?P<t>[\[\]*]*[A-Z][\w.]*))[ \t]*(?:`[^`\n]*`)?[ \t]*$", s.bare[d.body + 1 : d.end]):
                line = s.line(d.body + 1 + m.start())
                yield relation(d.qn, "INHERITS", m["e"].lstrip("*"), line) if m["e"] else relation(d.qn, "USES_TYPE", m["t"].lstrip("[]*"), line)


def parse_rust(module: str, source: str) -> Iterator[tuple]:
    """Rust: callables of ``impl`` blocks belong to their type, and a block for a trait implements it."""
    s = Scanner(module, source, GRAMMARS["rust"])
    blocks = []
    for m in re.finditer(r"(?m)^\s*(?:unsafe\s+)?impl\s*(?:<[^{>]*(?:<[^>]*>[^{>]*)*>)?\s*(?:(?P<trait>[\w:]+)(?:<[^{]*?>)?\s+for\s+)?&?(?P<type>[\w:]+)", s.bare):
        body, end = s.span(m.end())
        blocks.append((body, end, m["type"].rpartition("::")[2]))
        if m["trait"]:
            yield relation(f"{module}.{m['type'].rpartition('::')[2]}", "IMPLEMENTS", m["trait"].replace("::", "."), s.line(m.start("type")))
    inside = lambda line: next((t for a, b, t in blocks if s.line(a) <= line <= s.line(b)), None)
    moved = {}
    for row in s.rows():
        name, label, kind, short, rel, target, start = row[:7]
        owner = inside(start) if start else None
        if label == "Callable" and owner and name == f"{module}.{short}":
            moved[name, start] = f"{module}.{owner}.{short}"
            row = (moved[name, start], label, "method", *row[3:])
        elif rel == "DEFINES" and (target, start) in moved:
            row = (f"{module}.{owner}", *row[1:5], moved[target, start], *row[6:])
        elif rel == "CALLS":
            at = next((q for (n, line), q in moved.items() if n == name and inside(line) == owner), name)
            row = (at, *row[1:])
        elif rel == "IMPORTS":
            row = (*row[:5], re.sub(r"\s+", "", target).replace("::", "."), *row[6:])
        yield row


def parse_php(module: str, source: str) -> Iterator[tuple]:
    for row in scanned("php")(module, source):
        yield (*row[:5], row[5].replace("\\", "."), *row[6:]) if row[4] else row


def parse_ruby(module: str, source: str) -> Iterator[tuple]:
    """Ruby: classes, modules and methods end at the ``end`` of their own indentation."""
    lines = source.split("\n")
    yield entity(module, "Module", "module", module.rpartition(".")[2] or module, 1, len(lines))
    stack: list[tuple[int, str, str]] = []
    for n, raw in enumerate(lines, 1):
        line = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", lambda m: m[0][0] + " " * (len(m[0]) - 2) + m[0][-1], raw)
        line = re.sub(r"(?<!\S)#.*", "", line)
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip())
        while stack and (indent < stack[-1][0] or indent == stack[-1][0] and not re.match(r"\s*(?:end|else|elsif|rescue|ensure|when)\b", line)):
            stack.pop()
        owner, kind_above = (stack[-1][1], stack[-1][2]) if stack else (module, "Module")
        if m := re.match(r"\s*(class|module)\s+([A-Z][\w:]*)(?:\s*<\s*([A-Z][\w:]*))?", line):
            qn = f"{owner}.{m[2].replace('::', '.')}"
            end = next((i for i in range(n, len(lines)) if re.match(rf"\s{{{indent}}}end\b", lines[i])), len(lines) - 1) + 1
            yield entity(qn, "TypeDef", m[1] if m[1] == "class" else "trait", m[2], n, end)
            yield relation(owner, "DEFINES", qn, n)
            if m[3]:
                yield relation(qn, "INHERITS", m[3].replace("::", "."), n)
            stack.append((indent, qn, "TypeDef"))
        elif m := re.match(r"\s*def\s+(self\.)?([\w?!=\[\]+*/<>-]+)\s*(\([^)]*\))?", line):
            qn = f"{owner}.{m[2]}"
            end = next((i for i in range(n, len(lines)) if re.match(rf"\s{{{indent}}}end\b", lines[i])), n - 1) + 1
            yield entity(qn, "Callable", "class_method" if m[1] else "method" if kind_above == "TypeDef" else "function", m[2], n, end, signature=m[3] or "()")
            yield relation(owner, "DEFINES", qn, n)
            stack.append((indent, qn, "Callable"))
        elif m := re.match(r"\s*(?:require|require_relative|load)\s*\(?\s*['\"]", line):
            yield relation(module, "IMPORTS", re.search(r"['\"]([^'\"]+)", raw)[1], n)
        elif (m := re.match(r"\s*(?:include|extend|prepend)\s+([A-Z][\w:]*)", line)) and kind_above == "TypeDef":
            yield relation(owner, "INHERITS", m[1].replace("::", "."), n)
        else:
            at = next((q for _, q, k in reversed(stack) if k == "Callable"), module)
            yield from (relation(at, "CALLS", m[1].replace("::", "."), n) for m in re.finditer(r"(?<![\w.:@$])((?:[A-Za-z_][\w:]*\.)*[a-z_]\w*[?!]?)\s*\(", line) if m[1] not in NO_CALLS)


def parse_shell(module: str, source: str) -> Iterator[tuple]:
    """Shell: functions, sourced files, and calls of functions that the file defines."""
    g = Grammar(comments=r"(?m:(?<![\S$\\])#[^\n]*)", strings=r"\"(?:\\.|[^\"\\])*\"|'[^']*'", callables=((r"(?m)^[ \t]*(?:function[ \t]+(?P<name>[\w:.-]+)[ \t]*(?:\(\))?|(?P<other>[\w:.-]+)[ \t]*\(\))\s*(?=\{)", "function"),))
    s = Scanner(module, source, g)
    yield entity(module, "Module", "module", module.rpartition("/")[2], 1, len(s.lines))
    for m in re.finditer(g.callables[0][0], s.bare):
        name, (body, end) = m["name"] or m["other"], s.span(m.end())
        s.found.append(Declaration(f"{module}.{name}", "Callable", "function", name, m.start(), body, end))
    for d in s.found:
        yield entity(d.qn, "Callable", "function", d.name, s.line(d.start), s.line(d.end))
        yield relation(module, "DEFINES", d.qn, s.line(d.start))
    yield from (relation(module, "IMPORTS", m[1].strip("\"'"), s.line(m.start(1))) for m in re.finditer(r"(?m)^[ \t]*(?:source|\.)[ \t]+(\"[^\"\n]*\"|'[^'\n]*'|[^\s;&|]+)", s.code))
    known = {d.name for d in s.found}
    for m in re.finditer(r"(?m)(?:^|[;&|({`])[ \t]*(?:(?:then|do|else|if|elif|while|until|time|!)[ \t]+)*([\w:.-]+)(?![\w:.-]|[ \t]*\(\)|=)", s.bare):
        if m[1] in known:
            owner = s.around(m.start(1), "Callable")
            yield relation(owner.qn if owner else module, "CALLS", m[1], s.line(m.start(1)))


def parse_hcl(module: str, source: str) -> Iterator[tuple]:
    """HCL: blocks by type and labels, module sources, and references between blocks."""
    s = Scanner(module, source, Grammar(comments=r"//[^\n]*|#[^\n]*|/\*.*?\*/", strings=r"\"(?:\\.|[^\"\\\n])*\""))
    yield entity(module, "Module", "module", module.rpartition("/")[2], 1, len(s.lines))
    blocks = []
    for m in re.finditer(r"(?m)^[ \t]*(resource|data|module|variable|output|provider|locals|terraform)((?:[ \t]+\"[^\"\n]*\")*)[ \t]*\{", s.code):
        labels = re.findall(r"\"([^\"]*)\"", m[2])
        at = {"resource": labels, "data": ["data", *labels], "variable": ["var", *labels]}.get(m[1], [m[1], *labels])
        end = s.close.get(m.end() - 1, len(s.code))
        blocks.append((m[1], ".".join(at), m.start(1), m.end(), end, labels))
    for kind, address, start, body, end, labels in blocks:
        label = "TypeDef" if kind in ("resource", "data", "module") else "Value"
        yield entity(f"{module}.{address}", label, f"hcl_{kind}", labels[-1] if labels else kind, s.line(start), s.line(end))
        yield relation(module, "DEFINES", f"{module}.{address}", s.line(start))
        if kind == "module" and (m := re.search(r"(?m)^\s*source\s*=\s*\"([^\"]+)\"", s.code[body:end])):
            yield relation(module, "IMPORTS", m[1], s.line(body + m.start(1)))
        known = sorted((a for k, a, *_ in blocks if a != address and k not in ("provider", "locals", "terraform", "output")), key=len, reverse=True)
        for other in known:
            if m := re.search(rf"(?<![\w.]){re.escape(other)}(?![\w-])", s.code[body:end]):
                yield relation(f"{module}.{address}", "USES_TYPE", f"{module}.{other}", s.line(body + m.start()))


def parse_dockerfile(module: str, source: str) -> Iterator[tuple]:
    """Dockerfile: stages, the images and stages that they start from or copy from, variables."""
    text = re.sub(r"\\[ \t]*\n", lambda m: " " * (len(m[0]) - 1) + "\v", source)  # joined lines keep their number
    yield entity(module, "Module", "module", module.rpartition("/")[2], 1, source.count("\n") + 1)
    stage, names, number = module, [], 1
    for line in text.split("\n"):
        if m := re.match(r"\s*FROM\s+(?:--\S+\s+)*(\S+)(?:\s+AS\s+(\S+))?", line, re.I):
            name = m[2] or str(len(names))
            stage = f"{module}.{name}"
            yield entity(stage, "TypeDef", "docker_stage", name, number, number)
            yield relation(module, "DEFINES", stage, number)
            yield relation(stage, "IMPORTS", f"{module}.{m[1]}" if m[1] in names else m[1], number)
            names.append(name)
        elif m := re.match(r"\s*(?:COPY|ADD)\s+(?:--\S+\s+)*?--from=(\S+)", line, re.I):
            yield relation(stage, "IMPORTS", f"{module}.{m[1]}" if m[1] in names else m[1], number)
        elif m := re.match(r"\s*(?:ENV|ARG)\s+([A-Za-z_]\w*)", line, re.I):
            yield entity(f"{stage}.{m[1]}", "Value", "variable", m[1], number, number)
            yield relation(stage, "DEFINES", f"{stage}.{m[1]}", number)
        number += 1 + line.count("\v")


# ---------------------------------------------------------------- configuration


#: Levels of a key tree that become entities.
KEY_DEPTH = 3


def yaml_keys(source: str) -> Iterator[tuple[int, list[str], str]]:
    """(line, path of keys, scalar) of block mappings, by indentation; items of a list are numbered. Documents start anew at ``---``."""
    stack: list[tuple[int, str]] = []
    counts: dict[tuple, int] = {}
    quiet, doc = None, 0
    for n, raw in enumerate(source.split("\n"), 1):
        indent = len(raw) - len(raw.lstrip(" "))
        if quiet is not None and (not raw.strip() or indent > quiet):
            continue  # inside a block scalar
        quiet = None
        line = re.sub(r"(?:(?<=\s)|^)#.*$", "", raw).rstrip()
        if not line.strip():
            continue
        if line.startswith("---"):
            doc, stack = doc + 1, []
            continue
        text = line.lstrip(" ")
        while m := re.match(r"-(?:\s+|$)", text):
            while stack and (stack[-1][0] > indent or stack[-1][0] == indent and stack[-1][1].startswith("[")):
                stack.pop()
            above = (doc, *(k for _, k in stack))
            counts[above] = counts.get(above, -1) + 1
            stack.append((indent, f"[{counts[above]}]"))
            if not text[m.end() :]:
                text = ""
            elif not re.match(r"[^\s'\"{\[][^:]*:(?:\s|$)|['\"][^'\"]+['\"]\s*:(?:\s|$)|-", text[m.end() :]):
                yield n, [str(doc), *(k for _, k in stack)], text[m.end() :].strip().strip("'\"")
                text = ""
            indent, text = indent + m.end(), text[m.end() :] if text else ""
        if m := re.match(r"(?:'([^']*)'|\"([^\"]*)\"|([^\s'\"{\[&*!|>-][^:]*?|-[^\s:][^:]*?))\s*:(?:\s+(.*))?$", text):
            key, value = m[1] or m[2] or m[3] or "", (m[4] or "").strip()
            while stack and stack[-1][0] >= indent:
                stack.pop()
            stack.append((indent, key))
            if re.match(r"[|>][+-]?\d*$", value):
                quiet = indent
            yield n, [str(doc), *(k for _, k in stack)], value.strip("'\"")


def json_keys(value, path: list[str] | None = None) -> Iterator[tuple[int, list[str], str]]:
    path = path or ["0"]
    items = value.items() if isinstance(value, dict) else ((f"[{i}]", v) for i, v in enumerate(value)) if isinstance(value, list) else ()
    for k, v in items:
        yield 0, [*path, str(k)], "" if isinstance(v, (dict, list)) else str(v)
        yield from json_keys(v, [*path, str(k)])


def key_tree(module: str, keys: list[tuple[int, list[str], str]], lines: int) -> Iterator[tuple]:
    """What the keys of a configuration file declare: workloads, services, jobs and playbooks by their shape, else the tree of its keys."""
    yield entity(module, "Module", "module", module.rpartition("/")[2], 1, lines)
    tops = {p[1] for _, p, _ in keys if len(p) == 2}
    value = {tuple(p): v for _, p, v in keys}
    line = {tuple(p): n for n, p, _ in keys}

    def declare(qn: str, label: str, kind: str, name: str, at: tuple) -> Iterator[tuple]:
        yield entity(qn, label, kind, name, line.get(at, 0), line.get(at, 0))
        yield relation(module, "DEFINES", qn, line.get(at, 0))

    if {"apiVersion", "kind"} <= tops:  # a workload per document
        for doc in sorted({p[0] for p in value}):
            kind, name = value.get((doc, "kind"), ""), value.get((doc, "metadata", "name"), "")
            qn = f"{module}.{kind}/{name}"
            yield from declare(qn, "TypeDef", "k8s_" + kind.lower(), name or kind, (doc, "kind"))
            yield from (relation(qn, "IMPORTS", v, line[p]) for p, v in value.items() if p[0] == doc and p[-1] == "image" and v)
            yield from (relation(qn, "USES_TYPE", f"{module}.{ref}/{v}", line[p]) for p, v in value.items() if p[0] == doc and p[-1] == "name" and len(p) > 2 and (ref := {"configMapRef": "ConfigMap", "configMapKeyRef": "ConfigMap", "secretRef": "Secret", "secretKeyRef": "Secret"}.get(p[-2])))
    elif "services" in tops and not {"apiVersion", "kind"} & tops:  # services that depend on each other
        for p in [p for p in value if len(p) == 3 and p[1] == "services"]:
            qn = f"{module}.{p[2]}"
            yield from declare(qn, "TypeDef", "compose_service", p[2], p)
            for q, v in value.items():
                if q[:3] == p and len(q) >= 4 and q[3] == "image" and v:
                    yield relation(qn, "IMPORTS", v, line[q])
                elif q[:3] == p and len(q) == 5 and q[3] in ("depends_on", "links"):
                    yield relation(qn, "USES_TYPE", f"{module}.{v if q[4].startswith('[') else q[4]}", line[q])
    elif "jobs" in tops and ("on" in tops or "True" in tops):  # jobs that need each other, and the actions that they use
        for p in [p for p in value if len(p) == 3 and p[1] == "jobs"]:
            qn = f"{module}.{p[2]}"
            yield from declare(qn, "Callable", "ci_job", p[2], p)
            for q, v in value.items():
                if q[:3] == p and q[-1] == "uses" and v:
                    yield relation(qn, "IMPORTS", v, line[q])
                elif q[:3] == p and len(q) > 3 and q[3] == "needs":
                    yield from (relation(qn, "CALLS", f"{module}.{x}", line[q]) for x in re.findall(r"[\w.-]+", v))
    elif any(len(p) == 3 and p[1].startswith("[") and p[2] in ("hosts", "tasks", "roles") for p in value):  # plays of a book
        for p in sorted({q[:2] for q in value if q[1].startswith("[")}):
            name = value.get((*p, "name")) or p[1]
            qn = f"{module}.{name}"
            yield from declare(qn, "Callable", "play", name, (*p, "hosts"))
            yield from (relation(qn, "IMPORTS", v, line[q]) for q, v in value.items() if q[:2] == p and v and (len(q) == 4 and q[2] == "roles" or q[-1] in ("role", "include_tasks", "import_tasks", "import_playbook")))
    else:
        for n, p, _ in keys:
            if 2 <= len(p) <= KEY_DEPTH + 1 and not any(k.startswith("[") for k in p):
                at, above = [".".join([module, *(p[1:i])]) for i in (len(p), len(p) - 1)]
                yield entity(at, "Value", "config_key", p[-1], n, n)
                yield relation(above if len(p) > 2 else module, "CONTAINS" if len(p) > 2 else "DEFINES", at, n)


def parse_yaml(module: str, source: str) -> Iterator[tuple]:
    yield from key_tree(module, list(yaml_keys(source)), source.count("\n") + 1)


def parse_json(module: str, source: str) -> Iterator[tuple]:
    yield from key_tree(module, list(json_keys(json.loads(source))), source.count("\n") + 1)


def parse_toml(module: str, source: str) -> Iterator[tuple]:
    yield from key_tree(module, list(json_keys(tomllib.loads(source))), source.count("\n") + 1)


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def parse_xml(module: str, source: str) -> Iterator[tuple]:
    """XML: the tree of its elements, by tag and name or id; with metadata of an org, see ``parse_metadata``."""
    root = ET.fromstring(source.strip())
    yield entity(module, "Module", "module", module.rpartition("/")[2], 1, source.count("\n") + 1)
    todo = [(root, module, 1)]
    while todo:
        e, above, depth = todo.pop()
        name = e.get("id") or e.get("name") or _tag(e)
        qn = f"{above}.{name}"
        yield entity(qn, "Value", "config_key", name)
        yield relation(above, "DEFINES" if depth == 1 else "CONTAINS", qn)
        todo += [(c, qn, depth + 1) for c in e] if depth < KEY_DEPTH else []


def parse_metadata(module: str, source: str) -> Iterator[tuple]:
    """Org metadata (``*-meta.xml``): objects with their fields and lookups, flows with what they call, classes that pages and components use."""
    root = ET.fromstring(source.strip())
    kind, base = _tag(root), re.sub(r"\.[\w-]+-meta\.xml$", "", module.rpartition("/")[2])
    text = lambda e, tag: next((c.text or "" for c in e if _tag(c) == tag), "")
    name = text(root, "fullName") or base
    qn = f"{module}.{name}"
    yield entity(module, "Module", "module", module.rpartition("/")[2], 1, source.count("\n") + 1)
    yield entity(qn, "Callable" if kind == "Flow" else "TypeDef", f"sf_{kind[:1].lower()}{kind[1:]}", name, doc=text(root, "description") or None)
    yield relation(module, "DEFINES", qn)
    for e in root:
        tag = _tag(e)
        if tag in ("fields", "validationRules", "recordTypes", "listViews", "webLinks") and text(e, "fullName"):
            yield entity(f"{qn}.{text(e, 'fullName')}", "Value", f"sf_{tag.rstrip('s')}", text(e, "fullName"))
            yield relation(qn, "DEFINES", f"{qn}.{text(e, 'fullName')}")
        if tag in ("actionCalls", "subflows"):
            yield relation(qn, "CALLS", text(e, "actionName") or text(e, "flowName"))
        for x in e.iter():
            if _tag(x) in ("referenceTo", "object", "apexClass", "controller") and x.text:
                yield relation(qn, "IMPORTS", x.text)
    if kind == "CustomField" and text(root, "referenceTo"):
        yield relation(qn, "IMPORTS", text(root, "referenceTo"))


_JS = scanned("javascript")
LANGUAGES: dict[str, Callable[[str, str], Iterator[tuple]]] = {
    **dict.fromkeys((".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts"), _JS), ".java": scanned("java"), ".cs": scanned("csharp"),
    **dict.fromkeys((".c", ".h", ".cc", ".cpp", ".cxx", ".hpp", ".hh", ".hxx"), scanned("cpp")), ".go": parse_go, ".rs": parse_rust, ".php": parse_php, ".rb": parse_ruby,
    **dict.fromkeys((".cls", ".trigger"), scanned("apex")), **dict.fromkeys((".sh", ".bash", ".zsh"), parse_shell), **dict.fromkeys((".tf", ".hcl", ".tfvars"), parse_hcl),
    **dict.fromkeys((".yaml", ".yml"), parse_yaml), ".json": parse_json, ".toml": parse_toml, ".xml": parse_xml, "-meta.xml": parse_metadata, **dict.fromkeys(("Dockerfile", "Containerfile"), parse_dockerfile),
}
