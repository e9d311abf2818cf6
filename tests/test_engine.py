import json
import shutil
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest

from quern.engine import Engine
from quern.service import Service
from quern.sources.catalog import IndexMissing
from quern.sources.config import Config
from quern.streaming.ingest import ingest
from quern.streaming.merging import Merger

TEXT = {"name": "a", "fields": {"title": {"type": "text"}}}


@pytest.fixture()
def engine(spark, tmp_path):
    made = Engine(spark, str(tmp_path / "data"), str(tmp_path / "catalog"), Config(flush_max_documents=2, flush_max_postings=0))
    made.create_index(TEXT)
    return made


def test_ingest_reports_bad_ids(spark, engine):
    done = engine.index_documents("a", spark.createDataFrame([("1", "red fox"), (None, "x"), ("", "y")], "id string, title string"))
    assert done.indexed == 1 and sorted(done.errors) == ["document has no id (1)", "document id is empty (1)"]
    assert engine.index_documents("a", spark.createDataFrame([(7, "x")], "id int, title string")).errors == ("document id isn't a string (1)",)
    assert engine.get_index("a").doc_count == 1
    with pytest.raises(IndexMissing):
        engine.index_documents("none", spark.createDataFrame([("1",)], "id string"))


def test_search_page_delete_compact(spark, engine):
    engine.index_documents("a", spark.createDataFrame([(str(i), "fox " * (i + 1)) for i in range(12)], "id string, title string"))
    first, second, third = (engine.search("a", "fox", page=p, size=5) for p in (1, 2, 9))
    assert first.total == 12 and len(first.hits.collect()) == 5 and len(second.hits.collect()) == 5
    assert third.total == 12 and third.hits.collect() == [] and third.page == 9
    engine.delete("a", spark.createDataFrame([("3",)], "id string"))
    assert engine.search("a", "fox").total == 11
    assert engine.compact_if_due("a") is None
    engine.compact("a")
    assert engine.search("a", "fox").total == 11 and engine.stats("a")["docCount"] == 11
    assert engine.search_many("a", [("fox", ""), ("-fox", "")]).count() == 10


def test_catalog_beside_the_data(spark, tmp_path):
    one = Engine(spark, str(tmp_path / "data"))
    one.create_index(TEXT)
    one.index_documents("a", spark.createDataFrame([("1", "red fox")], "id string, title string"))
    again = Engine(spark, str(tmp_path / "data"))
    assert again.get_index("a").doc_count == 1 and again.search("a", "fox").total == 1


def test_flush_plan_follows_the_configuration(spark, engine):
    docs = spark.createDataFrame([(str(i), "a") for i in range(5)], "id string, title string")
    assert [r["segment"] for r in engine.flush_plan("a", docs, ["id"]).orderBy("id").collect()] == [0, 0, 1, 1, 2]


def test_streaming_restarts_without_repeating(spark, engine, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def arrive(name, rows):
        (source / name).write_text("\n".join(json.dumps(r) for r in rows))

    def run():
        stream = spark.readStream.schema("id string, title string, _deleted boolean").json(str(source))
        ingest(engine, "a", stream, str(tmp_path / "checkpoint")).awaitTermination()

    arrive("1.json", [{"id": "1", "title": "red fox"}, {"id": "2", "title": "fox"}])
    run()
    arrive("2.json", [{"id": "1", "title": "cat"}, {"id": "2", "_deleted": True}])
    run()
    run()
    assert [s.id for s in engine.segments("a").segments()] == ["batch-000000", "batch-000001"]
    assert engine.search("a", "fox").total == 0 and engine.search("a", "cat").total == 1
    assert engine.segments("a").manifest()["applied"] == 1


def test_service(engine):
    service = Service(engine)
    assert service.handle("GET", "/health")[0] == 200 and service.handle("GET", "/ready")[0] == 200
    assert service.handle("POST", "/v1/indexes", json.dumps(TEXT).encode())[0] == 409
    assert service.handle("POST", "/v1/indexes", b'{"name": ""}')[0] == 400 and service.handle("POST", "/v1/indexes", b"{")[0] == 400
    assert service.handle("POST", "/v1/indexes", json.dumps(TEXT | {"name": "b"}).encode())[0] == 201
    assert [d["name"] for d in service.handle("GET", "/v1/indexes")[1]["indexes"]] == ["a", "b"]
    assert service.handle("GET", "/v1/indexes/none")[0] == 404 and service.handle("GET", "/nowhere")[0] == 404
    body = json.dumps({"documents": [{"id": "1", "title": "red fox"}, {"title": "none"}]}).encode()
    status, told = service.handle("POST", "/v1/indexes/a/documents", body)
    assert status == 200 and told["indexed"] == 1 and told["errors"] == ["doc 1: document has no id"]
    status, told = service.handle("GET", "/v1/search?index=a&q=%2Bfox&pageSize=500&page=0")
    assert status == 200 and told["totalHits"] == 1 and told["pageSize"] == 100 and told["page"] == 1
    assert told["results"][0]["highlights"] == {"title": "red <em>fox</em>"}
    assert service.handle("GET", "/v1/search?index=a&q=")[0] == 400 and service.handle("GET", "/v1/search?index=a&q=x&page=z")[0] == 400
    assert service.handle("GET", "/v1/indexes/a/stats")[1]["docCount"] == 1
    told = service.handle("GET", "/metrics")[1]
    assert 'search_requests_total{index="a"} 1' in told and 'http_requests_total{method="GET",path="/v1/indexes/{index}/stats",status="200"} 1' in told
    assert 'search_latency_ms_bucket{index="a",le="+Inf"} 1' in told and 'segments{index="a"} 1' in told and "# TYPE http_request_duration_ms histogram" in told
    assert float(told.split('wal_offset_bytes{index="a"} ')[1].split("\n")[0]) > 0
    shutil.rmtree(f"{engine.root}/a/docs")
    status, told = service.handle("GET", "/ready")
    assert status == 503 and told["engines"] == 1 and told["registry"] == 2


def test_a_request_is_cut_into_segments(spark, engine):
    """Two documents a segment, by the configuration; errors name the place; what one request adds is visible at once."""
    rows = [{"id": "1", "title": "fox"}, {"id": 2, "title": "fox"}, "text", {"id": "3", "title": "fox"}, {"id": ""}, {"id": "4", "title": "fox", "ordinal": 9}, {"id": "1", "title": "cat"}, {"title": "x"}]
    done = engine.index_request("a", rows)
    assert done.indexed == 4 and len(done.segment_ids) == 2
    assert done.errors == ("doc 1: document id isn't a string", "doc 2: document isn't an object", "doc 4: document id is empty", "doc 7: document has no id")
    assert [s.documents for s in engine.segments("a").segments()] == [2, 2] and engine.segments("a").version() == 1
    assert engine.search("a", "fox").total == 2 and engine.search("a", "cat").total == 1
    assert engine.index_request("a", []).indexed == 0 and engine.index_request("a", [{}]).errors == ("doc 0: document has no id",)


def test_requests_at_a_time(engine):
    service = Service(engine)

    def post(k):
        return service.handle("POST", "/v1/indexes/a/documents", json.dumps({"documents": [{"id": f"{k}-{i}", "title": "fox"} for i in range(2)]}).encode())

    with ThreadPoolExecutor(3) as pool:
        assert all(status == 200 for status, _ in pool.map(post, range(6)))
    assert engine.search("a", "fox").total == 12 and engine.stats("a")["docCount"] == 12


def test_merging_in_the_background(engine):
    merger = engine.start_merging()
    try:
        for k in range(2):
            engine.index_request("a", [{"id": str(k), "title": "fox"}])
        assert merger.idle(60) and len(engine.segments("a").segments()) == 1 and engine.search("a", "fox").total == 2
        assert engine.ready()["ready"]
    finally:
        engine.close()


def test_requests_of_a_merge_are_one():
    started, go, done = threading.Event(), threading.Event(), []

    def compact(name):
        done.append(name)
        started.set()
        go.wait(10)
        if name == "bad":
            raise ValueError(name)

    merger = Merger(compact, lambda: ["timed"], 3600)
    merger.request("a")
    assert started.wait(10)
    for _ in range(5):
        merger.request("b")
        merger.request("bad")
    go.set()
    assert merger.idle(10) and done == ["a", "b", "bad"] and merger.alive()
    merger.close()
    timed = Merger(done.append, lambda: ["timed"], 0.05)
    for _ in range(200):
        if "timed" in done:
            break
        threading.Event().wait(0.05)
    timed.close()
    assert "timed" in done and not timed.alive()
