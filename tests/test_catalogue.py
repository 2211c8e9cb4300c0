import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from spanveil.plans import catalogue

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def engine():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert got
    if name in catalogue.oracle_sql():
        con = engine()
        want = con.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({catalogue.oracle_sql()[name]}) AS q").fetchall()
        assert got == sorted(want, key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_all_recognisers_run_on_all_cores(spark):
    """The customers are one file, which one task would read and redact."""
    df = catalogue.redact_all_recognisers(spark, SF)
    assert df._jdf.queryExecution().toRdd().getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_entry_needs_no_training_data_operators(tmp_path):
    """The entry without the optional parts: the same queries but theirs."""
    for name in ("__spark_entry__.py", "spanveil"):
        os.symlink(ROOT / name, tmp_path / name) if name.endswith(".py") else None
    target = tmp_path / "spanveil"
    target.mkdir()
    for item in (ROOT / "spanveil").iterdir():
        if item.name not in ("llm", "__pycache__"):
            os.symlink(item, target / item.name)
    code = "import sys; sys.dont_write_bytecode = True; import importlib.util as u; s = u.spec_from_file_location('e', '__spark_entry__.py'); e = u.module_from_spec(s); sys.path.insert(0, '.'); e.ROOT = '.'; s.loader.exec_module(e); print(sorted(e.queries()) and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline'], len(e.oracle_sql()))"
    entry = (ROOT / "__spark_entry__.py").read_text()
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(entry)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.stdout.split()[0] == "True", done.stderr[-800:]
