"""Every registered query against its DuckDB SQL, and what the entry module promises."""

import datetime
import decimal
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from paperloom import catalog
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: The driver compares at the second of these; branches that the first lacks occur there.
FOLDERS = [DATA, DATA.replace("sf0.001", "sf0.01")]


@pytest.fixture(scope="module", params=sorted(set(FOLDERS)))
def duck(request):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{request.param}/{t}.parquet'")
    return con, request.param


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return str(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    con, folder = duck
    df = catalog.queries()[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    r = con.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall()), key=str)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["doc_id", "merged", "units"]


def test_entry_imports_without_the_removable_parts(tmp_path):
    import os
    import shutil

    here = os.path.dirname(entry.__file__)
    shutil.copytree(f"{here}/paperloom", tmp_path / "paperloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert q and 'pipeline' not in q and not any(k.startswith('op') for k in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}).returncode == 0
