"""Every query with a SQL form gives the same rows in DuckDB; golden funnel counts hold."""

import pytest

from check import compare
from digestry.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
ROWS_ONLY = sorted(set(QUERIES) - set(ORACLES))

# Split: input, after leakage, after hard bounds, after fences, after first copies.
GOLDEN = {
    "sf0.001": {
        "test": (20, 20, 15, 13, 13),
        "train": (160, 160, 120, 106, 101),
        "validation": (20, 18, 13, 11, 11),
    },
    "sf0.01": {
        "test": (100, 89, 75, 68, 68),
        "train": (800, 800, 649, 598, 559),
        "validation": (100, 89, 68, 64, 64),
    },
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    outcome = compare(QUERIES[name](spark, SF), SF, ORACLES[name])
    assert outcome.startswith("ok"), outcome


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("sf", sorted(GOLDEN))
def test_golden_funnel(spark, sf):
    rows = QUERIES["prep_funnel"](spark, f"/root/testdata/{sf}").collect()
    stages = ("input", "after_leakage", "after_hard", "after_iqr", "after_dedup")
    assert {r["split"]: tuple(r[s] for s in stages) for r in rows} == GOLDEN[sf]
