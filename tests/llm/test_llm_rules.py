import duckdb
import pandas as pd

from mailsift.llm.quality_rules import SQL, quality_rules

ROWS = [(0, None), (1, ""), (2, "  \n\t\n"), (3, "one two three"), (4, "a b c d e f g h " * 30), (5, "word " * 5000),
        (6, "Home | About | Contact | Help\n" + "This line is a perfectly ordinary sentence of prose.\n" * 1),
        (7, "\n".join(f"Line {i} has w{i} some x{i} ordinary y{i} words, and z{i} ends." for i in range(30))),
        (8, "BUY NOW!! CHEAP!! THINGS!! HERE!!\n" * 20), (9, "x y\x1cz é ß " * 12), (10, "Same line here.\nSame line here.\nOther one.\n" * 9),
        (11, "$$$ ### *** &&& %%% | < >\n" * 3 + "fine words " * 40), (12, "\n".join("All rights reserved." for _ in range(25)))]


def test_counts_and_verdicts_equal_sql(spark):
    docs = spark.createDataFrame([(i, t, "x", True) for i, t in ROWS], "doc_id long, text string, lost string, kept boolean")
    got = quality_rules(docs).orderBy("doc_id").toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(ROWS, columns=["doc_id", "text"]))
    want = con.sql(SQL).df().sort_values("doc_id").reset_index(drop=True)
    for c in want.columns:
        assert got[c].tolist() == want[c].tolist(), c


def test_lines_go_and_documents_that_lose_too_much(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert got[7].kept and got[7].lines_removed == 0 and got[7].clean_text == dict(ROWS)[7]
    assert got[6].clean_text.startswith("This line") and got[6].lines_removed == 1
    assert not any(got[i].kept for i in (0, 1, 2, 3, 4, 5, 8, 12))
    assert got[0].base_failed and got[0].clean_text is None and got[1].clean_text == ""


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_in_the_plan(spark):
    plan = quality_rules(spark.createDataFrame(ROWS, "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
