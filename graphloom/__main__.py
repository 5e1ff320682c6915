"""Command line: ``python -m graphloom STORE COMMAND ...``; results are JSON."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession

GUIDE = """index FOLDER --project NAME   scan, extract, resolve and store
search QUERY                  names, text and vectors, fused
node NAME                     exact matches, then partial ones
sql TEXT                      a read-only query over nodes and edges
trace A B / impact UID        shortest path; what a change reaches
analyse NAME                  structure, centrality, dependencies, quality, dead_code, complexity, communities, ...
summary PREFIX / diagram KIND a path's skeleton; packages, imports, inheritance, module_detail
status / projects / health / lint / schema
mine-git-history REPO --project NAME / rm PROJECT"""


def envelope(df: DataFrame, limit: int = 100) -> dict:
    """The rows as {results, count, truncated, query_ms}."""
    from graphloom.operators.analysis import truncation_notice

    began = time.time()
    rows = [json.loads(x) for x in df.limit(limit + 1).toJSON().collect()]
    notice = truncation_notice(limit, df.count(), "raise --limit") if len(rows) > limit else None
    return {"results": rows[:limit], "count": min(len(rows), limit), "truncated": notice, "query_ms": round((time.time() - began) * 1000, 1)}


def run(spark: SparkSession, argv: list[str]) -> dict | list | str:
    from graphloom.operators import delta
    from graphloom.plans import guard
    from graphloom.sources import git, indexing
    from graphloom.sources.store import GraphStore

    p = argparse.ArgumentParser(prog="graphloom", epilog=GUIDE, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("store")
    p.add_argument("command")
    p.add_argument("args", nargs="*")
    p.add_argument("--project", default="main")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--direction", default="callers")
    o = p.parse_args(argv)
    store, limit, a = GraphStore(spark, o.store), guard.clamp(o.limit), o.args
    if o.command == "guide":
        return GUIDE
    if o.command == "index":
        changes = indexing.index_folder(store, a[0], o.project)
        indexing.run_detectors(store)
        return envelope(changes.groupBy("change").count(), limit)
    if o.command == "mine-git-history":
        commits = git.history(spark, a[0])
        modules = store.nodes.where("label = 'Module'").select("uid", "file_path")
        signals = delta.file_signals(commits, time.time()).withColumnRenamed("file", "file_path").join(modules, "file_path")
        store.set_columns(signals.selectExpr("uid", "commit_count AS git_commit_count", "author_count AS git_author_count", "days_since_last_commit AS git_days_since_last_commit"))
        store.write_co_changes(delta.co_changes(commits), o.project)
        return {"files": signals.count()}
    if o.command == "rm":
        store.delete_project(a[0])
        return {"removed": a[0]}
    table = {
        "search": lambda: store.search(a[0], limit), "node": lambda: store.get_node(a[0], limit=limit).orderBy("place"), "sql": lambda: guard.run_sql(store.nodes, store.edges, a[0], limit),
        "trace": lambda: store.trace(a[0], a[1]), "impact": lambda: store.impact(a[0], limit, direction=o.direction), "analyse": lambda: store.analyse(a[0]), "status": store.status, "projects": store.projects, "lint": store.lint,
        "context": lambda: store.context(a[0]),
    }
    plain = {"health": store.health, "schema": store.schema, "summary": lambda: store.summary(a[0]), "diagram": lambda: store.diagram(a[0], *a[1:2])}
    if o.command in plain:
        return plain[o.command]()
    if o.command not in table:
        p.error(f"unknown command {o.command!r}")
    return envelope(table[o.command](), limit)


def main() -> None:
    spark = SparkSession.builder.appName("graphloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    out = run(spark, sys.argv[1:])
    print(out if isinstance(out, str) else json.dumps(out, default=str, indent=2))


if __name__ == "__main__":
    main()
