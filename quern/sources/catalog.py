"""Named index definitions: fields, analyzer, BM25 parameters; validation and persistence."""

from __future__ import annotations

import json
import os
import re
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from quern.sources.storage import Files, local_json

TEXT, KEYWORD = "text", "keyword"
MOST_FIELDS, LONGEST_NAME = 64, 64


class CatalogError(ValueError):
    status = 400


class IndexExists(CatalogError):
    status = 409


class IndexMissing(CatalogError):
    status = 404


@dataclass(frozen=True)
class BM25:
    k1: float = 1.2
    b: float = 0.75

    def check(self) -> None:
        if not self.k1 > 0:
            raise CatalogError("bm25.k1 must be greater than 0")
        if not 0 <= self.b <= 1:
            raise CatalogError("bm25.b must lie between 0 and 1")


@dataclass(frozen=True)
class Field:
    type: str = TEXT
    weight: float = 1.0
    filter_only: bool = False


@dataclass(frozen=True)
class Definition:
    name: str
    fields: dict[str, Field]
    tokenizer: str = "standard"
    bm25: BM25 = BM25()
    doc_count: int = 0
    segments: tuple[dict, ...] = ()

    def to_dict(self) -> dict:
        return asdict(self) | {"segments": list(self.segments)}

    @staticmethod
    def from_dict(d: dict) -> Definition:
        fields = {k: Field(**v) for k, v in (d.get("fields") or {}).items()}
        return Definition(d["name"], fields, d.get("tokenizer", "standard"), BM25(**(d.get("bm25") or {})), d.get("doc_count", 0), tuple(d.get("segments") or ()))


@dataclass(frozen=True)
class CreateRequest:
    name: str = ""
    fields: dict[str, Field] = field(default_factory=dict)
    tokenizer: str = ""
    bm25: BM25 | None = None

    @staticmethod
    def from_dict(d: dict) -> CreateRequest:
        """From JSON; an object ``bm25`` replaces both values, and one that it lacks is 0."""
        fields = {k: Field(v.get("type", ""), float(v.get("weight") or 0), bool(v.get("filterOnly", False))) for k, v in (d.get("fields") or {}).items()}
        b = d.get("bm25")
        return CreateRequest(d.get("name") or "", fields, d.get("tokenizer") or "", None if b is None else BM25(float(b.get("k1") or 0), float(b.get("b") or 0)))

    def validate(self) -> None:
        name = self.name.strip()
        if not name:
            raise CatalogError("an index needs a name")
        if len(name.encode()) > LONGEST_NAME:
            raise CatalogError(f"the name is longer than {LONGEST_NAME} bytes")
        if not re.fullmatch(r"[^/\\\x00]+", name) or name in (".", ".."):
            raise CatalogError("the name can't be a file name")
        if not self.fields:
            raise CatalogError("an index needs at least one field")
        if len(self.fields) > MOST_FIELDS:
            raise CatalogError(f"more than {MOST_FIELDS} fields")
        for key, f in self.fields.items():
            if not key.strip():
                raise CatalogError("a field name is blank")
            if f.type not in (TEXT, KEYWORD):
                raise CatalogError(f"field '{key.strip()}' has the unknown type '{f.type}'")
            if f.weight < 0:
                raise CatalogError(f"field '{key.strip()}' has a negative weight")
        if self.bm25 is not None:
            self.bm25.check()

    def normalized_fields(self) -> dict[str, Field]:
        """Trimmed names; a weight of 0 is an absent one, that is 1."""
        return {k.strip(): replace(f, weight=f.weight or 1.0) for k, f in self.fields.items()}


class Catalog:
    """Definitions in memory, each with a JSON file: on the driver's disk, or wherever ``files`` reaches."""

    def __init__(self, folder: str, tokenizer: str = "", bm25: BM25 | None = None, files: Files | None = None):
        self.folder, self.files = folder, files
        self.tokenizer = tokenizer or "standard"
        given = bm25 or BM25(0, 0)
        self.bm25 = BM25(given.k1 or 1.2, given.b or 0.75)  # a default of 0 counts as none
        if files is None:
            os.makedirs(folder, exist_ok=True)
            found = load_definitions(folder)
        else:
            files.make(folder)
            found = [Definition.from_dict(files.read(f"{folder}/{n}")) for n in files.names(folder) if n.endswith(".json") and n[0] != "."]
        self._known = {d.name: d for d in found}

    def create(self, request: CreateRequest) -> Definition:
        request.validate()
        name = request.name.strip()
        if name in self._known:
            raise IndexExists(f"an index '{name}' exists")
        made = Definition(name, request.normalized_fields(), request.tokenizer or self.tokenizer, request.bm25 or self.bm25)
        self._save(made)
        return made

    def list(self) -> list[Definition]:
        return [d for _, d in sorted(self._known.items())]

    def get(self, name: str) -> Definition:
        if name not in self._known:
            raise IndexMissing(f"there is no index '{name}'")
        return self._known[name]

    def update(self, definition: Definition) -> None:
        self.get(definition.name)
        self._save(definition)

    def _save(self, definition: Definition) -> None:
        (local_json if self.files is None else self.files.write)(f"{self.folder}/{definition.name}.json", definition.to_dict())
        self._known[definition.name] = definition


def load_definitions(folder: str, recursive: bool = False) -> list[Definition]:
    """All definitions whose JSON files lie in a folder, and below it if so asked."""
    files = sorted(Path(folder).rglob("*.json") if recursive else Path(folder).glob("*.json"))
    return [Definition.from_dict(json.loads(p.read_text())) for p in files]
