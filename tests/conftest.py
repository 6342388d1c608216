import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def check_sql():
    """check(spark, name, query, sql, sf): the query's rows are the SQL's."""
    import duckdb

    def normal(rows):
        def cell(v):
            return f"{v:.9g}" if isinstance(v, float) else v.hex() if isinstance(v, (bytes, bytearray)) else str(v)

        return sorted(tuple(cell(v) for v in r) for r in rows)

    def check(spark, query, sql, sf="sf0.001"):
        folder = f"/root/testdata/{sf}"
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        for f in os.listdir(folder):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{f}')")
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        got = query(spark, folder)
        assert sorted(got.columns) == sorted(names)
        assert normal(got.select(*names).collect()) == normal(want.fetchall())

    return check
