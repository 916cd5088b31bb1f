import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from held import TABLES, differences

import __spark_entry__
from spindrift.plans import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], SMALL) == []


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_sitemap_recursion_numbers_more_than_ten_indexes(spark, tmp_path):
    """The names of indexes do not stand in the order of their numbers."""
    for name in TABLES:
        if name != "pages":
            (tmp_path / f"{name}.parquet").symlink_to(f"{SMALL}/{name}.parquet")
    ids = [2500 * k + more for k in range(23) for more in (0, 7, 51)]
    pq.write_table(pa.table({"page_id": ids, "url": ["https://x/"] * len(ids), "html": [""] * len(ids)}), tmp_path / "pages.parquet")
    assert differences(spark, catalogue.QUERIES["sitemap_recursion"], catalogue.ORACLE_SQL["sitemap_recursion"], str(tmp_path)) == []
