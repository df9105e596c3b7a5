"""Every query of the engine runs on the small tables; those with a SQL twin give its rows."""

import os

import pytest
from tessera.plans import registry

from . import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
#: Queries whose split needs more days or items than the smallest tables have.
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, con, name):
    assert compare.rows_of(QUERIES[name](spark, SF)) == compare.oracle_rows(con, ORACLE[name])


@pytest.mark.parametrize("name", ["html_extract", "semantic_chunks", "hier_chunks", "analyze_drift", "ate_tests", "lin_ols", "uplift_scores", "qini_coefficient", "ppml", "ease_topk", "prompt_pack", "excerpt", "judge_scores", "holiday_flags"])
def test_runs(spark, name):
    assert name in QUERIES and QUERIES[name](spark, SF).columns
    QUERIES[name](spark, SF).count()
