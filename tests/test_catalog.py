"""Registered queries against DuckDB on the smallest tables; the entry point without the training-data part."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

from noteloom.plans import catalog
from tests.conftest import ROOT

#: Enough to keep the run short; the driver compares all of them.
CHECKED = ("bm25_topk", "bm25_no_dedup", "lexical_search", "cosine_search_boost", "rrf_fuse", "proper_nouns", "keyword_items", "link_edges", "cocitation_edges", "modularity", "debounce_sessions", "lease_state", "fewshot_topk", "excerpts", "hashes")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf_dir, duck, name):
    got, want = catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns) and len(got) == len(want)
    left, right = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for c in columns:
        assert ((left[c] == right[c]) | (left[c].isna() & right[c].isna())).all(), c


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry_works_without_the_training_data_part(tmp_path):
    for name in ("__spark_entry__.py", "noteloom"):
        os.symlink(ROOT / name, tmp_path / name) if name.endswith(".py") else None
    (tmp_path / "noteloom").mkdir()
    for part in os.listdir(ROOT / "noteloom"):
        if part != "llm":
            os.symlink(ROOT / "noteloom" / part, tmp_path / "noteloom" / part)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-B", "-c", code], check=True, cwd=tmp_path, env=env)
