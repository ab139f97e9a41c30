"""Every query of the library beside its SQL in DuckDB, on the smallest tables; and the driver's contract."""

import subprocess
import sys
from pathlib import Path

import pytest

from tallyspark.jobs import catalog

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT / "scripts"))
import compare as tool  # noqa: E402

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).is_dir(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    return tool.tables(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    got = [tuple(r) for r in df.collect()]
    if name in catalog.ORACLE:
        rel = duck.execute(catalog.ORACLE[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == sorted(df.columns)
        assert tool.rows_of(df.columns, got) == tool.rows_of(names, rel.fetchall())


def test_every_sql_has_a_query():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1


def test_entry_without_the_text_subpackage(tmp_path):
    """The other queries stay when the subpackage and its pipeline are deleted."""
    subprocess.run(["cp", "-r", str(ROOT / "tallyspark"), str(ROOT / "__spark_entry__.py"), str(tmp_path)], check=True)
    (tmp_path / "tallyspark" / "llm").rename(tmp_path / "gone")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.stdout.split() == [str(len(catalog.QUERIES)), "False"], out.stderr
