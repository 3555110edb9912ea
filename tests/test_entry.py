"""The driver's contract: queries against their SQL on the smallest tables, with and without the llm subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
import duckdb
import pandas as pd
import pytest

SF = Path("/root/testdata/sf0.001")
from tracemill.plans import registry  # noqa: E402

ROOT = Path(entry.__file__).resolve().parent


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def _rows(df):
    df = df[sorted(df.columns)]
    key = lambda v: "null" if pd.isna(v) else repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(key(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.skipif(not SF.is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, db, name):
    got, want = registry.QUERIES[name](spark, str(SF)).toPandas(), db.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry_lists_all(spark):
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if SF.is_dir():
        assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_text_operators(tmp_path, pipeline):
    """The rest lives without the llm folders, be the pipeline's file there or not."""
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "tracemill", tmp_path / "tracemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True).stdout.split("\n")
    assert set(out[0].split()) == set(registry.QUERIES) and set(out[1].split()) == set(registry.ORACLES)
