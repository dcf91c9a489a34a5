import os
import subprocess
import sys

import pytest

from .conftest import ROOT

DATA = "/root/testdata/sf0.001"


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}).returncode == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["timeline_coverage", "det_brute", "entities_ip", "lineage_parents", "link_persistence", "sigma_one_of", "mitre_coverage", "ingest_event_xml", "ingest_event_json", "ingest_services", "ingest_tasks", "ingest_refused", "entities_parts", "coverage_parts", "events_query_after", "clusters_grown"])
def test_queries_as_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = e.queries()[name](spark, DATA)
    rows = con.execute(e.oracle_sql()[name])
    columns = [c[0] for c in rows.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got.select(*columns).collect())) == sorted(map(key, rows.fetchall()))
