import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same_rows(spark):
    """Whether a query and its SQL give the same rows on one of the test tables' folders."""
    import duckdb

    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

    def check(query, sql: str, sf_dir: str = "/root/testdata/sf0.001", only: list[str] | None = None):
        con = duckdb.connect()
        for t in names:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = con.sql(sql)
        columns = only or sorted(want.columns)
        at = [want.columns.index(c) for c in columns]
        expected = sorted(repr([r[i] for i in at]) for r in want.fetchall())
        got = query(spark, sf_dir)
        assert only or sorted(got.columns) == columns
        assert sorted(repr([r[c] for c in columns]) for r in got.select(*(f"`{c}`" for c in columns)).collect()) == expected

    return check
