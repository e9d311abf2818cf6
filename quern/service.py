"""The engine's JSON interface: requests in, (status, payload) out, and a small HTTP server for it."""

from __future__ import annotations

import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from quern.engine import Engine
from quern.plans.parser import parse_int
from quern.sources.catalog import CatalogError, IndexMissing


class Service:
    def __init__(self, engine: Engine):
        self.engine = engine

    def handle(self, method: str, target: str, body: bytes = b"") -> tuple[int, object]:
        began, url = time.time(), urlsplit(target)
        path, params = url.path.rstrip("/"), {k: v[0] for k, v in parse_qs(url.query).items()}
        try:
            status, payload = self._route(method, path, params, body)
        except IndexMissing as e:
            status, payload = 404, {"error": str(e)}
        except CatalogError as e:
            status, payload = e.status, {"error": str(e)}
        except (ValueError, KeyError, TypeError) as e:
            status, payload = 400, {"error": str(e)}
        # Labels are routes, not names: as many as there are routes.
        parts = path.strip("/").split("/")
        route = "/" + "/".join("{index}" if i == 2 and parts[:2] == ["v1", "indexes"] else p for i, p in enumerate(parts)) if status != 404 else "other"
        labels = {"method": method, "path": route, "status": status}
        self.engine.metrics.count("http_requests_total", **labels)
        self.engine.metrics.observe("http_request_duration_ms", (time.time() - began) * 1000, **labels)
        if status >= 400:
            self.engine.metrics.count("http_errors_total", **labels)
        return status, payload

    def _route(self, method: str, path: str, params: dict[str, str], body: bytes) -> tuple[int, object]:
        e, parts = self.engine, path.strip("/").split("/")
        match (method, parts):
            case ("GET", ["health" | "healthz"]):
                return 200, {"status": "ok"}
            case ("GET", ["ready" | "readyz"]):
                told = e.ready()
                status = 200 if told.pop("ready") else 503
                return status, {"status": "ready" if status == 200 else "initializing", "lastStatus": status, **told}
            case ("GET", ["metrics"]):
                return 200, e.metrics.text() if e.config.metrics else {"enabled": False}
            case ("POST", ["v1", "indexes"]):
                return 201, e.create_index(json.loads(body)).to_dict()
            case ("GET", ["v1", "indexes"]):
                return 200, {"indexes": [d.to_dict() for d in e.list_indexes()]}
            case ("GET", ["v1", "indexes", name]):
                return 200, e.get_index(name).to_dict()
            case ("GET", ["v1", "indexes", name, "stats"]):
                return 200, e.stats(name)
            case ("POST", ["v1", "indexes", name, "documents"]):
                e.get_index(name)
                rows = json.loads(body)["documents"]
                if not isinstance(rows, list):
                    raise ValueError("documents isn't a list")
                done = e.index_request(name, rows)
                return (200 if done.indexed else 400), {"indexed": done.indexed, "segmentIds": list(done.segment_ids), "errors": list(done.errors)}
            case ("GET", ["v1", "search"]):
                index, q = params.get("index", ""), params.get("q", "")
                if not index or not q:
                    raise ValueError("index and q are required")
                found = e.search(index, q, params.get("filters", ""), parse_int(params.get("page"), 1), parse_int(params.get("pageSize"), 10))
                hits = [json.loads(x) for x in found.hits.toJSON().collect()]
                return 200, {"index": index, "query": q, "totalHits": found.total, "page": found.page, "pageSize": found.size, "results": hits, "timingMs": found.taken_ms}
        return 404, {"error": "not found"}


def serve(engine: Engine) -> ThreadingHTTPServer:
    """A server on the configured address, with merging in the background; call ``serve_forever`` on it."""
    service = Service(engine)
    engine.start_merging()

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, payload = service.handle(self.command, self.path, body)
            plain = isinstance(payload, str)
            data = (payload if plain else json.dumps(payload, default=str)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain; version=0.0.4" if plain else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer

        def log_message(self, *args: object) -> None:
            if engine.config.request_logs:
                super().log_message(*args)

    host, _, port = engine.config.listen.rpartition(":")
    return ThreadingHTTPServer((host, int(port)), Handler)
