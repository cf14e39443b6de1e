"""Boilerplate removal against its SQL and by hand."""

import duckdb
import pandas as pd

import odd
from conftest import SF_SMALL
from lorewell.llm import line_spread
from lorewell.llm.queries import LINE_SPREAD_SQL, QUERIES


def compare(spark, frame):
    docs = spark.createDataFrame(frame, "doc_id long, source string, text string")
    out = line_spread.remove_boilerplate(docs).selectExpr("doc_id", "n_lines", "n_removed", "sha2(coalesce(text, ''), 256) AS kept_sha256").collect()
    con = duckdb.connect()
    con.register("documents", frame)
    key = lambda r: tuple(map(str, r))
    want = con.execute(f"SELECT doc_id, n_lines, n_removed, kept_sha256 FROM ({LINE_SPREAD_SQL})").fetchall()
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)
    return out


def test_spread_and_copies(spark):
    rows = []
    for i in range(40):
        lines = [odd.words(i * 10 + j, 9) for j in range(4)]
        lines.insert(i % 4, "shared footer")
        if i % 20 < 9:
            lines.append("on nine sites")
        rows.append((i, f"s{i % 20}", "\n".join(lines)))
    copied = "\n".join(odd.words(900 + j, 12) for j in range(5))
    rows += [(100 + i, f"s{i % 20}", copied) for i in range(30)]
    rows += [(200, None, "shared footer\n\nshared footer"), (201, "s1", None), (202, "s2", ""), (203, "s3", "\n\n"), (204, "s4", "shared footer")]
    out = compare(spark, pd.DataFrame(rows, columns=["doc_id", "source", "text"]))
    by = {r.doc_id: r for r in out}
    assert by[0].n_removed == 0 and all(by[i].n_removed == 1 for i in range(1, 40))  # kept where it is first
    assert all(by[100 + i].n_removed == 0 for i in range(30))  # copies are no boilerplate
    assert by[200].n_removed == 2 and by[204].n_removed == 1 and by[201].n_lines == 1


def pages(first, n, shared):
    """``n`` pages on 40 sites, three lines of their own each and ``shared`` lines that all have."""
    footer = [f"{odd.words(5000 + j, 6)} footer" for j in range(shared)]
    return [(first + i, f"s{i % 40}", "\n".join([odd.words(10_000 + 3 * i + j, 9) for j in range(3)] + footer)) for i in range(n)]


def test_footers_of_many_lines(spark):
    out = compare(spark, pd.DataFrame(pages(0, 400, 10), columns=["doc_id", "source", "text"]))
    assert sum(r.n_removed for r in out) == 3990 and max(r.n_removed for r in out) == 10


def test_copies_do_not_outvote(spark):
    rows = pages(0, 400, 1)
    rows += [(1000 + i, f"s{i % 40}", rows[7][2]) for i in range(450)]
    by = {r.doc_id: r.n_removed for r in compare(spark, pd.DataFrame(rows, columns=["doc_id", "source", "text"]))}
    assert by[0] == 0 and all(by[i] == 1 for i in range(1, 400))
    assert all(by[1000 + i] == 1 for i in range(450))  # the copies lose the footer, not the rest


def test_contexts_at_the_limit(spark):
    for contexts, gone in ((9, False), (10, True)):
        rows = [(i, f"s{i % 20}", f"on all\n{odd.words(i % contexts, 9)} {i % contexts} of {contexts}") for i in range(60)]
        by = {r.doc_id: r.n_removed for r in compare(spark, pd.DataFrame(rows, columns=["doc_id", "source", "text"]))}
        assert (by[59] > 0) == gone


def test_registered_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    got = sorted(map(tuple, QUERIES["op4_line_site_spread"](spark, SF_SMALL).collect()))
    assert got == sorted(con.execute(f"SELECT doc_id, n_lines, n_removed, kept_sha256 FROM ({LINE_SPREAD_SQL})").fetchall())


def test_odd_rows(spark):
    docs = odd.documents(spark)
    out = line_spread.remove_boilerplate(docs)
    assert out.count() == len(odd.rows()) and out.columns == [*docs.columns, "n_lines", "n_removed"]
    assert {r.text for r in out.where("doc_id IS NULL").collect()} == {None, dict(odd.pairs()[:1])[1]}
    assert line_spread.remove_boilerplate(docs.limit(0)).count() == 0


def test_no_python_on_the_main_path(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for frame in (QUERIES["op4_line_site_spread"](spark, SF_SMALL), line_spread.widespread_lines(docs)):
        plan = frame._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
