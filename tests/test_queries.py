"""Every core query against its SQL on the smallest tables; queries without SQL only have to run."""

import functools
from pathlib import Path

import duckdb
import pytest

import verify
from burstframe import plans

SF = "/root/testdata/sf0.001"


def core():
    import importlib
    import pkgutil

    modules = [importlib.import_module(f"burstframe.plans.{m.name}") for m in pkgutil.iter_modules(plans.__path__)]
    return {n: (f, m.ORACLE.get(n)) for m in modules for n, f in m.QUERIES.items()}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.fixture(scope="module", autouse=True)
def steps_made_once():
    """The queries of one course share its steps here; each query by itself makes them anew."""
    from burstframe.plans import bursts, language_training

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(bursts, "Course", functools.cache(bursts.Course))
        patch.setattr(language_training, "Training", functools.cache(language_training.Training))
        yield


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are missing")
@pytest.mark.parametrize("name", sorted(core()))
def test_query(spark, con, name):
    f, sql = core()[name]
    df = f(spark, SF)
    got = verify.rows(df.columns, [tuple(r) for r in df.collect()])
    if sql:
        cur = con.execute(sql)
        assert sorted(c[0] for c in cur.description) == sorted(df.columns)
        assert got == verify.rows([c[0] for c in cur.description], cur.fetchall())


def test_llm_is_not_needed():
    for p in (Path(plans.__file__).parents[1]).rglob("*.py"):
        if "llm" not in p.parts:
            assert "burstframe.llm" not in p.read_text()
