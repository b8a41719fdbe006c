import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def against_sql(spark):
    """Runs a query and its SQL over a folder of tables and asserts equal rows."""
    import duckdb

    def same(query, sql, folder="/root/testdata/sf0.001"):
        con = duckdb.connect()
        for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            con.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
        df = query(spark, folder)
        cols = sorted(df.columns)
        norm = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in rows)
        assert norm(tuple(r[c] for c in cols) for r in df.collect()) == norm(con.sql(f"select {','.join(cols)} from ({sql})").fetchall())

    return same
