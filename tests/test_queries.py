"""Every registered query of the library's own operators against its SQL."""

import pytest

from keyloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, same):
    same(catalogue.QUERIES[name], catalogue.SQL[name])


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_varint_len_of_products_beyond_a_long(spark, tmp_path):
    """Keys of a large table: their products pass 2^63 and 2^64; nulls, as in the SQL, take 9."""
    import duckdb

    rows = [(1, 1), (0, 5), (9_000_000, 900_000), (2**31, 2**33), (2**40, 2**36), (4 * 10**9, 0), (308_360, 1_000_000), (308_361, 1_000_000), (None, 3), (3, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {(r.id, r.bytes) for r in catalogue.QUERIES["varint_len"](spark, str(tmp_path)).collect()}
    products = {k: k * k * c * 97 for k, c in rows if k is not None and c is not None}
    assert got == {(k, max(1, -(-v.bit_length() // 7))) for k, v in products.items()} | {(None, 9), (3, 9)}
    assert max(products.values()) > 2**120 and products[308_360] < 2**63 <= products[308_361]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet' WHERE o_orderkey IS NULL OR o_custkey IS NULL OR o_orderkey < 308361")
    assert set(con.execute(catalogue.SQL["varint_len"]).fetchall()) <= got
