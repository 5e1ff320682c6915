"""Query text: the read-only guard, static checks and strategy hints."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import DataFrame, SparkSession

from graphloom.schema import LABELS, REL_TYPES

# Statements that write.
_WRITES = re.compile(r"\b(INSERT|UPDATE|DELETE|MERGE|CREATE|DROP|ALTER|TRUNCATE|REPLACE\s+TABLE|LOAD|REFRESH|CACHE|UNCACHE|SET|RESET|ADD\s+(?:JAR|FILE)|MSCK|ANALYZE|GRANT|REVOKE)\b", re.I)
_STRINGS = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
LIMIT = (1, 100, 20)


def clamp(limit: int | None) -> int:
    low, high, default = LIMIT
    return default if limit is None else max(low, min(high, limit))


def check_sql(text: str, spark: SparkSession | None = None) -> list[str]:
    """Problems of a read query: writes, unbalanced brackets, no SELECT, unknown labels or relationship types, no LIMIT; with a session
    also what its parser says."""
    bare = _STRINGS.sub(" ", text)
    out = [f"writes: {m[1].upper()}" for m in [_WRITES.search(bare)] if m]
    out += [f"unbalanced {a}{b}" for a, b in ("()", "[]") if bare.count(a) != bare.count(b)]
    if not re.match(r"\s*(?:WITH|SELECT|FROM|VALUES|TABLE)\b", bare, re.I):
        out.append("not a query")
    for column, known in (("label", LABELS), ("rel_type", REL_TYPES)):
        for value in re.findall(rf"\b{column}\s*(?:=|IN\s*\()\s*'([^']*)'", text, re.I):
            if value not in known:
                near = difflib.get_close_matches(value, known, 1)
                out.append(f"unknown {column} {value!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
    if spark is not None:
        from pyspark.errors import ParseException

        try:
            spark._jsparkSession.sessionState().sqlParser().parsePlan(text.rstrip().rstrip(";"))
        except ParseException as error:
            out.append(f"does not parse: {error.getCondition()}")
    if not re.search(r"\bLIMIT\b", bare, re.I):
        out.append("no LIMIT: one is added")
    return out


def run_sql(nodes: DataFrame, edges: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """A read-only query over views ``nodes`` and ``edges``, cut to a limit."""
    errors = [e for e in check_sql(text) if not e.startswith("no LIMIT")]
    if errors:
        raise ValueError("; ".join(errors))
    spark: SparkSession = nodes.sparkSession
    nodes.createOrReplaceTempView("nodes")
    edges.createOrReplaceTempView("edges")
    return spark.sql(text.rstrip().rstrip(";")).limit(clamp(limit))


# Words that tell what a question is about.
KNOWLEDGE = re.compile(r"\b(why|decisions?|gotchas?|rationale|trade-?offs?|motivation|learn(?:s|ed|t|ing)?|lessons?)\b", re.IGNORECASE)
STRUCTURE = re.compile(r"\b(call(?:s|ed|er|ing)|inherit|base|parent|child|import|depend|override|implement|test(?:s|ed|ing)?)\b", re.IGNORECASE)
DOCUMENTS = re.compile(r"\b(doc(?:s|umentation|string)?|readme|adr|explained|description)\b", re.IGNORECASE)
RELATIONS = (("call", "CALLS"), ("inherit", "INHERITS"), ("base", "INHERITS"), ("parent", "INHERITS"), ("import", "IMPORTS"), ("depend", "DEPENDS_ON"), ("override", "OVERRIDES"), ("implement", "IMPLEMENTS"), ("test", "TESTS"))


def search_strategy(question: str) -> str:
    """What a question asks for: knowledge (rationale), structure, documents, names or meaning, in this order."""
    from graphloom.operators.search import analyse_query

    text = question.strip()
    for pattern, topic in ((KNOWLEDGE, "knowledge"), (STRUCTURE, "structure"), (DOCUMENTS, "documents")):
        if pattern.search(text):
            return topic
    return "names" if analyse_query(text)["graph"] >= 2.0 else "meaning"


def plan_search(question: str) -> dict[str, object]:
    """The tool that suits a question, and its options."""
    from graphloom.operators.search import analyse_query

    topic = search_strategy(question)
    if topic == "structure":
        return {"topic": topic, "tool": "sql", "options": {}, "relationship": next((rel for word, rel in RELATIONS if word in question.lower()), None)}
    options = {"knowledge": {"mode": "knowledge"}, "documents": {"channels": ("bm25", "vector"), "weights": {"bm25": 1.5, "vector": 2.0}}, "names": {}, "meaning": {"weights": analyse_query(question)}}
    return {"topic": topic, "tool": "get_node" if topic == "names" else "hybrid_search", "options": options[topic]}
