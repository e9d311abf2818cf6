import json

import pytest

from quern.sources.catalog import BM25, Catalog, CatalogError, CreateRequest, IndexExists, IndexMissing, load_definitions
from quern.sources.config import Config, load, seconds

GOOD = {"name": "articles", "fields": {" title ": {"type": "text", "weight": 2}, "tags": {"type": "keyword", "filterOnly": True}}, "tokenizer": "standard_en", "bm25": {"k1": 1.5, "b": 0.7}}


def test_create_and_reload(tmp_path):
    made = Catalog(str(tmp_path)).create(CreateRequest.from_dict(GOOD))
    assert made.fields["title"].weight == 2 and made.fields["tags"].weight == 1 and made.fields["tags"].filter_only
    again = Catalog(str(tmp_path))
    assert again.get("articles") == made and made.doc_count == 0 and made.segments == ()
    with pytest.raises(IndexExists):
        again.create(CreateRequest.from_dict(GOOD))
    with pytest.raises(IndexMissing):
        again.get("other")


@pytest.mark.parametrize(
    "change",
    [
        {"name": " "}, {"name": "ä" * 33}, {"name": "../x"}, {"fields": {}}, {"fields": {" ": {"type": "text"}}}, {"fields": {"a": {"type": "number"}}}, {"fields": {"a": {"type": "text", "weight": -1}}},
        {"fields": {f"f{i}": {"type": "text"} for i in range(65)}}, {"bm25": {"b": 0.5}}, {"bm25": {"k1": 1, "b": 1.5}},
    ],
)
def test_validation(change):
    with pytest.raises(CatalogError):
        CreateRequest.from_dict(GOOD | change).validate()


def test_list_defaults_and_recursive_load(tmp_path):
    catalog = Catalog(str(tmp_path), "standard_en", BM25(2.0, 0))
    for name in ("b", "a"):
        catalog.create(CreateRequest.from_dict({"name": name, "fields": {"x": {"type": "text"}}}))
    assert [d.name for d in catalog.list()] == ["a", "b"]
    assert catalog.get("a").bm25 == BM25(2.0, 0.75) and catalog.get("a").tokenizer == "standard_en"
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.json").write_text(json.dumps({"name": "c", "fields": {"x": {"type": "text"}}}))
    assert [d.name for d in load_definitions(str(tmp_path))] == ["a", "b"]
    assert {d.name for d in load_definitions(str(tmp_path), recursive=True)} == {"a", "b", "c"}


TOML = '[server]\nlisten = ":9"\n[index_defaults]\nmerge_interval = "45s"\nmerge_threshold = 6\nflush_max_documents = 0\n[index_defaults.bm25]\nk1 = 1.4\nb = 0.7\n[logging]\nrequest_logs = false\n'
YAML = "server:\n  listen: ':9'\nindex_defaults:\n  merge_interval: 45s\n  merge_threshold: 6\n  flush_max_documents: 0\n  bm25:\n    k1: 1.4\n    b: 0.7\nlogging:\n  request_logs: false\n"


@pytest.mark.parametrize("name, text", [("c.toml", TOML), ("c.yaml", YAML), ("c.yml", YAML)])
def test_config_files(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    c = load(str(tmp_path / name), environ={"QUERN_INDEX_PATH": "/env"})
    assert (c.listen, c.merge_interval, c.merge_threshold, c.flush_max_documents, c.bm25, c.request_logs, c.metrics, c.index_dir) == (":9", 45.0, 6, 512, BM25(1.4, 0.7), False, True, "/env")
    assert load(str(tmp_path / name), index_dir="/flag", listen=":1", environ={"QUERN_INDEX_PATH": "/env"}).index_dir == "/flag"


def test_config_defaults_and_errors(tmp_path):
    assert load(environ={}) == Config()
    with pytest.raises(ValueError):
        load(str(tmp_path / "c.ini"))
    assert seconds("1m30s") == 90 and seconds(2_000_000_000) == 2
    with pytest.raises(ValueError):
        seconds("soon")
