"""Registered queries against their DuckDB SQL, and the import guard."""
import decimal
import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
from tidewheel.plans import registry

SF = "/root/testdata/sf0.001"
PICKED = [
    "p5_agg_qc_report", "p6_prj_canonical_id", "j2_jn_full_outer_components", "a4_agg_net_flow", "a5_agg_throughput", "a7_agg_weighted_curve", "a8_agg_daily_to_monthly", "a10_agg_repair_daily", "a13_agg_reliability_system",
    "a16_agg_window_gaps", "g3_geo_grid_zones", "j7_jn_nearest", "j11_jn_next_within", "m2_ml_weather_reg", "m17_ml_walk_forward", "d1_ds_slice_totals", "f9_fn_flow_peaks", "st2_st_unusable_rate", "st3_st_persistence", "s10_snk_json_doc",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no generated tables here")


def _normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(lambda v: "NULL" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else repr(round(float(v), 9)) if isinstance(v, (float, decimal.Decimal)) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        path = f"{SF}/{f}" + ("/*.parquet" if os.path.isdir(f"{SF}/{f}") else "")
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.SQL[name]).df()
    assert _normal(got).equals(_normal(want))


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_sql_text_has_a_query():
    assert contract.oracle_sql().keys() <= contract.queries().keys()


def test_entry_imports_without_the_training_data_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in os.listdir(root):
        if name in ("__spark_entry__.py",):
            os.symlink(f"{root}/{name}", tmp_path / name)
    (tmp_path / "tidewheel").mkdir()
    for name in os.listdir(f"{root}/tidewheel"):
        if name != "llm":
            os.symlink(f"{root}/tidewheel/{name}", tmp_path / "tidewheel" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op') for k in q) and len(q) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
