import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402

from lumirank.registry import queries, sql  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "topk_cosine", "topk_cell_join", "upsert_replayed", "micro_batches", "log_throughput", "row_index_sliced",
    "text_search_top10", "embed_images", "topk_many_queries", "topk_grid", "topk_approx", "upsert_rewritten", "delivery_stats", "resolve_existing_path", "stream_ingest",
    "preprocess_rgba", "topk_sparse", "topk_stored", "decode_json_any", "stream_throughput_live",
]


def test_every_query_has_its_sql():
    assert set(queries.queries()) == set(sql.oracle_sql())
    assert not set(entry.oracle_sql()) - set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    import duckdb
    from compare import rows

    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    got, want = entry.queries()[name](spark, FOLDER).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and len(got)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_entry_runs(spark):
    assert entry.entry(spark).limit(5).count() == 5
