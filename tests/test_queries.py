"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from tests.conftest import SF
from trimlake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    assert sorted(db.sql(registry.oracle_sql()[name]).columns) == cols
    listed = ", ".join(f'"{c}"' for c in cols)
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, db.sql(f"SELECT {listed} FROM ({registry.oracle_sql()[name]})").fetchall()))


def test_checksums(spark):
    import zlib

    rows = registry.queries()["checksums"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    assert rows and all(r["crc32"] == (None if r["text"] is None else zlib.crc32(r["text"].encode())) for r in rows)


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["page_id", "original_size", "optimized_size", "success"]
    assert rows.selectExpr("sum(original_size - optimized_size)").first()[0] == 690


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.queries()["html_strip"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan and "Exchange" not in plan
    plan = registry.queries()["orphans"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan


def test_files_without_the_operators_for_training_data(tmp_path):
    """The entry module works where that subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    from tests.conftest import ROOT

    shutil.copytree(f"{ROOT}/trimlake", tmp_path / "trimlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'html_strip' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)} | {k: v for k, v in __import__("os").environ.items() if k.startswith(("JAVA", "SPARK"))})
