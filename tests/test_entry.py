"""The driver's contract, the command line, and that the engine stands without the llm subpackage."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from silvestra import __main__ as cli
from silvestra import queries as paths

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_queries_match_sql(spark):
    db = duckdb.connect()
    db.sql("SET TimeZone='UTC'")
    for p in Path(DATA).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name in ("q02_attr_equal", "q11_position", "q13_last", "q22_word_search_texts", "q24_parent_once", "q26_down_up_down", "q31_relative", "q34_export", "q35_html_adapter", "q37_single_language", "q39_next_sibling"):
        df = paths.QUERIES[name](spark, DATA)
        want = db.sql(paths.ORACLE_SQL[name])
        cols = sorted(df.columns)
        assert cols == sorted(want.columns), name
        rows = sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect())))
        assert rows == sorted(map(str, db.sql(f"SELECT {', '.join(cols)} FROM ({paths.ORACLE_SQL[name]})").fetchall())), name
    assert __spark_entry__.entry(spark).count() == 5


def test_every_query_has_sql():
    assert set(paths.QUERIES) == set(paths.ORACLE_SQL)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stands_without_llm(tmp_path):
    code = "import sys; sys.modules['silvestra.llm'] = None; import __spark_entry__ as e; assert e.llm is None and set(e.queries()) == set(e.oracle_sql())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": str(ROOT)})


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.xml").write_text("<?xml version='1.0'?><c><id>a</id><id>b</id></c>")
    silo = str(tmp_path / "silo")
    assert cli.main(["compile", silo, str(tmp_path / "a.xml")], spark) == 0
    assert cli.main(["query", silo, "c/id[text()='b']"], spark) == 0 and capsys.readouterr().out == "<id>b</id>\n"
    assert cli.main(["query", silo, "c/nothing"], spark) == 1
    (tmp_path / "q").write_text("c/id\nc|c/id\n")
    assert cli.main(["query-file", silo, str(tmp_path / "q")], spark) == 0 and capsys.readouterr().out == "c/id: 2\nc|c/id: 3\n"
    assert cli.main(["export", silo], spark) == 0 and "<id>a</id>" in capsys.readouterr().out
    assert cli.main(["dump", silo], spark) == 0 and "id" in capsys.readouterr().out
    assert cli.main(["query", str(tmp_path / "none"), "c"], spark) == 1
