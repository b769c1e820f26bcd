import os
import subprocess
import sys

import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
#: Queries of the core; those of optional subpackages are tested there.
CORE = [n for m in __spark_entry__._modules() if m.__name__.startswith("sitequarry.plans.") for n in m.QUERIES]


@pytest.mark.parametrize("name", CORE)
def test_query_runs_on_the_smallest_tables(spark, name):
    rows = __spark_entry__.queries()[name](spark, SMALL)
    assert rows.columns and len(set(rows.columns)) == len(rows.columns)
    rows.write.format("noop").mode("overwrite").save()


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), timeout=120)


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
