"""Resolution of names that very many share: work follows rows and results, not pairs. And ladders against brute force."""

from contextlib import contextmanager
from threading import Timer

import pytest
from pyspark.sql import functions as F

from graphloom.operators import resolve as R

MANY = 40_000  # of each side: 1.6 billion pairs


@pytest.fixture
def soon(spark):
    @contextmanager
    def limit(seconds=60):
        timer = Timer(seconds, spark.sparkContext.cancelAllJobs)
        timer.start()
        try:
            yield
        finally:
            timer.cancel()

    return limit


def rows(spark, n=MANY, **cols):
    return spark.range(n).select(*(F.expr(e).alias(c) for c, e in cols.items()))


def test_members_of_a_common_name(spark, soon):
    refs = rows(spark, ref_id="id", member_uid="concat('m', id)", project_name="'p'", name="'get'", file_path="concat('d', id, '/f')", fallback_uid="'mod'")
    types = rows(spark, uid="concat('t', id)", project_name="'p'", name="'get'", file_path="concat('d', id, if(id < 10, '/f', '/g'))")
    with soon():
        got = R.resolve_members(refs, types).where("from_uid = replace(to_uid, 'm', 't')").count()
    assert got == MANY


def test_members_by_rung(spark):
    types = spark.createDataFrame([("t1", "p", "T", "d/a"), ("t2", "p", "T", "d/b"), ("t3", "p", "U", "e/a"), (None, "p", "U", "d/a")], "uid string, project_name string, name string, file_path string")
    cases = [("T", "d/a", "t1"), ("T", "d/c", "mod"), ("T", "x/a", "mod"), ("U", "d/a", "t3"), ("V", "d/a", "mod"), ("U", None, "t3"), (None, "d/a", "mod")]
    refs = spark.createDataFrame([(i, f"m{i}", "p", n, f, "mod") for i, (n, f, _) in enumerate(cases)], "ref_id int, member_uid string, project_name string, name string, file_path string, fallback_uid string")
    got = {r.to_uid: r.from_uid for r in R.resolve_members(refs.unionByName(refs.where("ref_id = 4")), types).collect()}
    assert got == {f"m{i}": c[2] for i, c in enumerate(cases)} and R.resolve_members(refs, types).count() == len(cases)


def test_type_refs_of_a_common_name(spark, soon):
    refs = rows(spark, ref_id="id", from_uid="concat('c', id)", project_name="'p'", name="'get'", file_path="concat('f', id)")
    types = rows(spark, uid="concat('t', id)", project_name="'p'", name="'get'", file_path="concat('f', id)")
    imports = rows(spark, 2, from_file="'f7'", to_uid="concat('t', id)")
    with soon():
        got = R.resolve_type_refs(refs, types, imports)
        assert {(r.strategy, r.n) for r in got.groupBy("strategy").agg(F.count("*").alias("n")).collect()} == {("import", 2), ("same_file", MANY - 1)}


def test_expand_cuts_large_keys(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 4)
    monkeypatch.setattr(R, "CELL", 10)
    monkeypatch.setattr(R, "TASK", 50)
    left = rows(spark, 30, at="id", k="if(id < 25, 1, id)")
    right = rows(spark, 20, k="if(id < 17, 1, id)", to_uid="concat('t', id)", own="id % 2")
    want = left.join(right, "k").select("at", "k", "own", "to_uid")
    got = R.expand(left.unionByName(left.where("at = 3")), right, ["k"], "test", "own")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.unionByName(want.where("at = 3")).collect()))


@pytest.mark.parametrize("left_n, right_n", [(300, 20), (20, 300)])
def test_expand_bounds_tasks_and_deals_once(spark, monkeypatch, left_n, right_n):
    for name, value in (("BLOCK", 4), ("PART", 2), ("CELL", 10), ("TASK", 5), ("TASKS", 7)):
        monkeypatch.setattr(R, name, value, raising=False)
    # a constant column among the keys, as a project's name may be
    left = rows(spark, left_n, at="id", p="if(id >= 0, 'w', 'v')", k="id % 2").localCheckpoint()
    right = rows(spark, right_n, p="'w'", k="id % 3", to_uid="concat('t', id)")
    got = R.expand(left, right, ["p", "k"], "test")
    assert got.rdd.getNumPartitions() == 7  # not one a few pairs, and not dealt anew into spark.sql.shuffle.partitions
    want = left.join(right, ["p", "k"]).select("at", "p", "k", "to_uid")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_doc_links_of_a_common_name(spark, soon):
    refs = rows(spark, ref_id="id", from_uid="concat('d', id)", project_name="'p'", target="if(id % 2 = 0, 'get', 'f.py')", is_file="id % 2 = 1", link_type="'mention'", confidence="0.5D")
    ents = rows(spark, uid="concat('e', id)", label="'Callable'", project_name="'p'", name="'get'", file_path="concat('src/d', id, '/f.py')")
    refs = refs.unionByName(refs.where("ref_id = 0").selectExpr("-1 AS ref_id", "from_uid", "project_name", "'d5/f.py' AS target", "true AS is_file", "link_type", "confidence"))
    with soon():
        assert [tuple(r) for r in R.doc_links(refs, ents).collect()] == [("d0", "e5", "DOCUMENTS", "mention", 0.5)]


def test_handlers_of_a_common_name(spark, soon):
    refs = rows(spark, from_uid="concat('o', id)", project_name="'p'", file_path="concat('f', id)", name="'get'")
    ents = rows(spark, uid="concat('e', id)", label="'Callable'", project_name="'p'", name="'get'", file_path="concat('f', id + 5)")
    imports = spark.createDataFrame([("f0", "e9"), ("f0", "e8"), ("f7", "e9")], "from_file string, to_uid string")
    with soon():
        got = {(r.from_uid, r.to_uid) for r in R.registered_by(refs, ents, imports).collect()}
    assert got == {("o0", "e8"), ("o0", "e9"), *((f"o{i}", f"e{i - 5}") for i in range(5, MANY))}


def test_handlers_in_several_rows(spark):
    ents = spark.createDataFrame([("a", "f"), ("a", "f"), ("a", "g"), ("b", "f"), ("c", "h"), ("h", "f")], "uid string, file_path string").selectExpr("uid", "'Value' AS label", "'p' AS project_name", "'n' AS name", "file_path")
    refs = spark.createDataFrame([("h", "f"), ("h", "f"), ("h", "g"), ("c", "h"), ("x", "z")], "from_uid string, file_path string").selectExpr("from_uid", "'p' AS project_name", "file_path", "'n' AS name")
    imports = spark.createDataFrame([("h", "b"), ("h", "a"), ("z", "c"), ("g", "c")], "from_file string, to_uid string")
    got = sorted((r.from_uid, r.to_uid) for r in R.registered_by(refs, ents, imports).collect())
    assert got == [("c", "a"), ("c", "b"), ("h", "a"), ("h", "b"), ("x", "c")]


def test_calls_in_a_file_with_many_imports(spark, soon):
    sites = rows(spark, site_id="id", from_uid="concat('o', id)", project_name="'p'", name="concat('n', id)", file_path="'f'", line="1", owner="'T'", receiver="CAST(NULL AS STRING)", has_receiver="false", from_test="false")
    callables = rows(spark, uid="concat('c', id)", project_name="'p'", name="concat('n', id)", file_path="'g'", owner="'U'", is_abstract="false")
    imports = rows(spark, from_file="'f'", to_uid="concat('c', id)")
    with soon():
        got = R.resolve_calls(sites, callables, imports, F.col("c.file_path").startswith("tests/"))
        assert got.where("strategy = 'import' AND candidate_count = 1 AND replace(from_uid, 'o', 'c') = to_uid").count() == MANY == got.count()
