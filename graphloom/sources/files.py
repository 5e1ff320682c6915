"""Source files: scanning with ignore rules, projects, manifests."""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.expressions import any_of

# Folders and files that a scan leaves out unless told otherwise, and files that mark a project's root.
DEFAULT_EXCLUDES = (
    ".git/", ".hg/", ".svn/", ".bzr/", ".fossil/",
    ".idea/", ".vscode/", ".vs/", ".eclipse/",
    "__pycache__/", ".venv/", "venv/", ".eggs/", "*.pyc", "*.pyo", ".mypy_cache/", ".ruff_cache/", ".pytest_cache/", ".pytype/", ".tox/", ".nox/", "site-packages/", "__pypackages__/", ".pdm-build/",
    "node_modules/", "bower_components/", ".next/", ".nuxt/", ".svelte-kit/",
    "target/", ".gradle/", "build/", "dist/", "out/", "vendor/", ".env/", ".direnv/", ".cache/", ".parcel-cache/", ".turbo/", ".claude/", ".cursor/", ".copilot/", ".terraform/",
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "Cargo.lock", "composer.lock", "Gemfile.lock", ".terraform.lock.hcl", "*.min.json",
    ".env", ".env.*", "*.env", "*.pem", "*.key", "*.p12", "*.pfx", "*.keystore", "*.jks", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", ".npmrc", ".netrc", ".pypirc",
    "credentials", "credentials.*", "secrets.*", "secret.*", "*-secrets.*", "*.secrets.*", "service-account*.json", "*-key.json", "*.tfvars", "*.tfvars.json", "local.settings.json", ".ssh/", ".aws/", ".gnupg/",
)
PROJECT_MARKERS = ("pyproject.toml", "package.json", "Cargo.toml", "go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "composer.json", "Gemfile")


def ignore_regex(pattern: str) -> tuple[str, bool]:
    """(Java regular expression over a relative path, negated) of one line of an ignore file: ``*`` and ``?`` stay within a part, ``**``
    crosses parts, a leading slash anchors, a trailing one means a folder."""
    negated = pattern.startswith("!")
    p = pattern.lstrip("!").strip()
    folder, anchored = p.endswith("/"), "/" in p.rstrip("/")
    p = p.strip("/")
    out = "".join({"**": ".*", "**/": "(?:.*/)?", "*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", p))
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/.*' if folder else '(?:/.*)?'}$", negated


def not_ignored(files: DataFrame, patterns: list[str], path: str = "path") -> DataFrame:
    """Files that the ignore rules leave; of the rules that match, the last decides."""
    verdict = F.lit(False)
    for pattern in patterns:
        if pattern.strip() and not pattern.startswith("#"):
            expression, negated = ignore_regex(pattern)
            verdict = F.when(F.col(path).rlike(expression), F.lit(not negated)).otherwise(verdict)
    return files.where(~verdict)


def nested_rules(files: DataFrame, names: tuple[str, ...] = (".gitignore", ".graphloomignore")) -> list[tuple[str, list[str]]]:
    """(folder, rules) of the ignore files of a tree, shallow ones first. ``files``: path, text."""
    base = F.substring_index("path", "/", -1)
    rows = files.where(base.isin(*names)).select("path", "text").collect()
    found = [(r["path"].rpartition("/")[0], (r["text"] or "").splitlines()) for r in rows]
    return sorted(found, key=lambda x: (x[0].count("/") + bool(x[0]), x[0]))


def under_rules(files: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """Files that nested ignore files leave: a rule counts below its folder, and the last that matches decides."""
    verdict = F.lit(False)
    for folder, patterns in rules:
        prefix = f"{folder}/" if folder else ""
        inner = F.when(F.col("path").startswith(prefix), F.substring("path", len(prefix) + 1, 1 << 20))
        for pattern in patterns:
            if pattern.strip() and not pattern.startswith("#"):
                expression, negated = ignore_regex(pattern.rstrip())
                verdict = F.when(inner.rlike(expression), F.lit(not negated)).otherwise(verdict)
    return files.where(~verdict)


def scan(spark: SparkSession, root: str, excludes: tuple[str, ...] = DEFAULT_EXCLUDES, includes: tuple[str, ...] = (), prefixes: tuple[str, ...] = ()) -> DataFrame:
    """(path, text, length) of the files below ``root`` by any path that Spark reads; paths are relative, with slashes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = "/" + re.sub(r"^\w+://[^/]*", "", root).strip("/") + "/"
    out = files.select(F.substring_index("path", base, -1).alias("path"), F.col("content").cast("string").alias("text"), "length")
    if prefixes:
        out = out.where(any_of([F.col("path").startswith(p) for p in prefixes]))
    kept = not_ignored(under_rules(out, nested_rules(out)), list(excludes))
    if includes:
        kept = kept.where(any_of([F.col("path").rlike(ignore_regex(i)[0]) for i in includes]))
    return kept


def detect_projects(files: DataFrame, markers: tuple[str, ...] = PROJECT_MARKERS, explicit: dict[str, str] | None = None) -> DataFrame:
    """(root, name, markers) of every folder that holds a marker, and of the ``explicit`` ones (path: name, or empty), which win; equal names get
    their parents in front. Shallow ones come first."""
    at = files.select(F.regexp_replace("path", "/?[^/]*$", "").alias("root"), F.regexp_extract("path", "([^/]*)$", 1).alias("file"))
    found = at.where(F.col("file").isin(*markers)).groupBy("root").agg(F.array_sort(F.collect_set("file")).alias("markers"))
    given = {p.replace("\\", "/").strip("/"): n for p, n in (explicit or {}).items()}
    if given:
        rows = files.sparkSession.createDataFrame([(p, ["explicit"]) for p in given], found.schema)
        found = found.where(~F.col("root").isin(*given)).unionByName(rows)
    base = F.when(F.col("root") == "", "root").otherwise(F.substring_index("root", "/", -1))
    for path, name in given.items():
        base = F.when(F.col("root") == path, name or path.replace("/", "-")).otherwise(base)
    named = found.withColumn("name", base).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("name")))
    return named.withColumn("name", F.when(F.col("_n") > 1, F.replace("root", F.lit("/"), F.lit("-"))).otherwise(F.col("name"))).select("root", "name", "markers").orderBy(F.size(F.split("root", "/")), "root")


def owning_project(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Files with the project whose root is their longest prefix: every folder above a file is a key of an equi-join."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    hit = files.select("path", F.explode(above).alias("root")).join(projects.select("root", F.col("name").alias("project_name")), "root")
    best = hit.groupBy("path").agg(F.max_by("project_name", F.length("root")).alias("project_name"))
    return files.join(best, "path", "left")


def prioritised(files: DataFrame) -> DataFrame:
    """Deep files first, package initialisers last of their depth."""
    depth = F.size(F.split("path", "/"))
    return files.orderBy(depth.desc(), F.col("path").endswith("__init__.py"), "path")


# ---------------------------------------------------------------- manifests


def _requirement(text: str) -> tuple[str, str]:
    m = re.match(r"\s*([A-Za-z0-9_.\-]+)(?:\[[^\]]*\])?\s*([^;#]*)", text)
    return (m[1], m[2].strip()) if m else ("", "")


def _pyproject(text: str) -> Iterator[tuple[str, str]]:
    data = tomllib.loads(text)
    project = data.get("project", {})
    for line in [*project.get("dependencies", []), *(x for g in project.get("optional-dependencies", {}).values() for x in g)]:
        name, version = _requirement(line)
        yield name.replace("-", "_"), version
    for name, spec in data.get("tool", {}).get("poetry", {}).get("dependencies", {}).items():
        yield name, spec if isinstance(spec, str) else spec.get("version", "") if isinstance(spec, dict) else ""


def _json_sections(*sections: str) -> Callable[[str], Iterator[tuple[str, str]]]:
    def parse(text: str) -> Iterator[tuple[str, str]]:
        data, seen = json.loads(text), set()
        for s in sections:  # the first section that names a package decides
            for name, version in (data.get(s) or {}).items():
                if name not in seen:
                    seen.add(name)
                    yield name, version

    return parse


def _cargo(text: str) -> Iterator[tuple[str, str]]:
    data = tomllib.loads(text)
    tables = [data.get(s, {}) for s in ("dependencies", "dev-dependencies", "build-dependencies")] + [data.get("workspace", {}).get("dependencies", {})]
    for table in tables:
        for name, spec in table.items():
            yield name.replace("-", "_"), spec if isinstance(spec, str) else spec.get("version", "")


def _go_mod(text: str) -> Iterator[tuple[str, str]]:
    text = re.sub(r"(?ms)^\s*(?:replace|exclude|retract)\s*(?:\(.*?^\s*\)|[^(\n]*$)", "", text)
    yield from re.findall(r"^\s*(?:require\s+)?([\w.\-]+\.[\w.\-]+/[^\s]+)\s+(v[^\s]+)", text, re.M)


def _pom(text: str) -> Iterator[tuple[str, str]]:
    root = ET.fromstring(re.sub(r'\sxmlns="[^"]*"', "", text, count=1))
    for d in root.iter("dependency"):
        yield f"{d.findtext('groupId', '')}:{d.findtext('artifactId', '')}", d.findtext("version", "") or ""


def _gradle(text: str) -> Iterator[tuple[str, str]]:
    for group, artifact, version in re.findall(r"""(?:implementation|api|compileOnly|runtimeOnly|testImplementation|kapt)\s*\(?\s*["']([^:"']+):([^:"']+)(?::([^"']+))?["']""", text):
        yield f"{group}:{artifact}", version


def _gemfile(text: str) -> Iterator[tuple[str, str]]:
    for name, version in re.findall(r"""^\s*gem\s+["']([^"']+)["'](?:\s*,\s*["']([^"']+)["'])?""", text, re.M):
        yield name, version


MANIFESTS: dict[str, Callable[[str], Iterator[tuple[str, str]]]] = {
    "pyproject.toml": _pyproject, "package.json": _json_sections("dependencies", "devDependencies", "optionalDependencies", "peerDependencies"), "Cargo.toml": _cargo, "go.mod": _go_mod,
    "pom.xml": _pom, "build.gradle": _gradle, "build.gradle.kts": _gradle, "composer.json": _json_sections("require", "require-dev"), "Gemfile": _gemfile,
}


def register_manifest(name: str, parse: Callable[[str], Iterator[tuple[str, str]]]) -> None:
    MANIFESTS[name] = parse


def dependency_versions(files: DataFrame) -> DataFrame:
    """(package, version) that manifests ask for; a package with different constraints is left out, a broken manifest gives nothing.
    ``files``: path, text."""
    known = dict(MANIFESTS)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += [(n.lower(), str(v)) for n, v in known[path.rsplit("/", 1)[-1]](text or "") if n]
                except (ValueError, ET.ParseError, AttributeError, TypeError):
                    continue
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["package", "version"])

    manifests = files.where(F.substring_index("path", "/", -1).isin(*known)).select("path", "text")
    found = manifests.mapInArrow(run, "package string, version string").where("version <> ''").distinct()
    return found.groupBy("package").agg(F.count(F.lit(1)).alias("_n"), F.min("version").alias("version")).where("_n = 1").select("package", "version")
