"""Every query with SQL against it, on the smallest tables; and what the driver's entry promises."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from echofold.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(table):
    names = sorted(table.column_names)
    plain = lambda x: "null" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x)
    return names, sorted(tuple(plain(r[c]) for c in names) for r in table.to_pylist())


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_against_sql(spark, duck, name):
    assert rows(registry.queries()[name](spark, SF).toArrow()) == rows(duck.execute(registry.oracle_sql()[name]).to_arrow_table())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["group_id", "path", "size_bytes", "action"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_corpus_operators(tmp_path):
    root = Path(__file__).resolve().parents[1]
    for p in root.rglob("*.py"):
        at = p.relative_to(root)
        if "llm" not in at.parts and at.name != "corpus_pipeline.py":
            (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / at).write_bytes(p.read_bytes())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'keep_default' in q and 'pipeline' not in q and not any(x.startswith('op') for x in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=True)
