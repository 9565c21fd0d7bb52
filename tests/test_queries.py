"""Every query against its SQL; queries without SQL run and are tested elsewhere."""

import duckdb
import pytest
from compare import differences, duck

from dialogmill.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert differences(registry.QUERIES[name](spark, sf_dir), registry.SQL[name], con) is None


def test_entry_registers_everything(spark):
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_importers_keep_short_answers(spark, tmp_path):
    said = "I built the cache with Kafka and Redis and measured its latency every single day"  # 15 words
    rows = [(4, i, role, text) for i, (role, text) in enumerate([("assistant", "What did you build there?"), ("user", said), ("assistant", said), ("user", "Thank you.")])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    for name in ("interview_import", "dialogue_import", "message_tree"):
        df = registry.QUERIES[name](spark, str(tmp_path))
        assert df.count() == 1, name
        assert differences(df, registry.SQL[name], con) is None
