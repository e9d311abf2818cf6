import __spark_entry__ as entry


def test_every_oracle_has_its_query():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    assert {"search_and", "search_phrase", "multi_query_batch", "stream_ingest_search"} <= names


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["id", "score"] and 0 < rows.count() <= 10
