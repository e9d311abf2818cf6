"""Configuration: defaults, then a TOML or YAML file, then an environment variable, then arguments."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, replace

from quern.sources.catalog import BM25

PATH_VARIABLE = "QUERN_INDEX_PATH"
_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}


@dataclass(frozen=True)
class Config:
    listen: str = ":8080"
    index_dir: str = "data/indexes"
    tokenizer: str = "standard"
    bm25: BM25 = BM25()
    merge_interval: float = 30.0  # seconds
    merge_threshold: int = 4
    flush_max_documents: int = 512
    flush_max_postings: int = 50_000
    request_logs: bool = True
    metrics: bool = True


def seconds(value: object) -> float:
    """A duration: a number of nanoseconds, or text such as "45s" or "1m30s"."""
    if isinstance(value, (int, float)):
        return value / 1e9
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)", str(value))
    if not parts or "".join(a + b for a, b in parts) != str(value):
        raise ValueError(f"not a duration: {value!r}")
    return sum(float(a) * _UNITS[b] for a, b in parts)


def load(path: str = "", index_dir: str = "", listen: str = "", environ: dict[str, str] | None = None) -> Config:
    """Later sources win; in a file, zeros and empty texts don't count, but ``false`` does."""
    config = Config()
    if path:
        config = merged(config, _parsed(path))
    from_env = (os.environ if environ is None else environ).get(PATH_VARIABLE, "")
    if index_dir or from_env:
        config = replace(config, index_dir=index_dir or from_env)
    return replace(config, listen=listen) if listen else config


def _parsed(path: str) -> dict:
    kind = os.path.splitext(path)[1].lower()
    if kind == ".toml":
        with open(path, "rb") as f:
            return tomllib.load(f)
    if kind in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError:
            with open(path) as f:
                return _plain_yaml(f.read())
        with open(path) as f:
            return yaml.safe_load(f) or {}
    raise ValueError("a configuration file ends in .toml, .yaml or .yml")


def _plain_yaml(text: str) -> dict:
    """Nested maps of scalars, which is all that a configuration needs, where no YAML library is there."""
    root: dict = {}
    stack = [(-1, root)]
    for line in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not line:
            continue
        indent = len(line) - len(line.lstrip())
        key, colon, value = line.strip().partition(":")
        if not colon:
            raise ValueError(f"not understood: {line!r}")
        while stack[-1][0] >= indent:
            stack.pop()
        value = value.strip()
        if not value:
            stack[-1][1][key] = {}
            stack.append((indent, stack[-1][1][key]))
        elif value[0] in "\"'":
            stack[-1][1][key] = value.strip("\"'")
        elif value in ("true", "false"):
            stack[-1][1][key] = value == "true"
        else:
            stack[-1][1][key] = float(value) if re.fullmatch(r"[+-]?\d*\.\d+", value) else int(value) if re.fullmatch(r"[+-]?\d+", value) else value
    return root


def merged(base: Config, file: dict) -> Config:
    defaults = file.get("index_defaults") or {}
    bm25 = defaults.get("bm25") or {}
    interval = defaults.get("merge_interval")
    found = {
        "listen": (file.get("server") or {}).get("listen"), "index_dir": (file.get("paths") or {}).get("index_dir"), "tokenizer": defaults.get("tokenizer"),
        "merge_interval": seconds(interval) if interval else None, "merge_threshold": defaults.get("merge_threshold"),
        "flush_max_documents": defaults.get("flush_max_documents"), "flush_max_postings": defaults.get("flush_max_postings"),
    }
    out = replace(base, **{k: v for k, v in found.items() if v})
    out = replace(out, bm25=BM25(float(bm25.get("k1") or out.bm25.k1), float(bm25.get("b") or out.bm25.b)))
    for name, value in (("request_logs", (file.get("logging") or {}).get("request_logs")), ("metrics", (file.get("metrics") or {}).get("enabled"))):
        if value is not None:
            out = replace(out, **{name: bool(value)})
    return out
