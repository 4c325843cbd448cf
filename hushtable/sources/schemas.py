"""Public schemas from files: a Python file that defines SCHEMA, or a JSON document."""

from __future__ import annotations

import importlib.util
import json
import sys
from pathlib import Path

from hushtable.functions.bins import Schema


def load_schema(path: str) -> Schema:
    """The schema of a file on the driver. A Python file is run, and may import what lies beside it."""
    file = Path(path)
    if not file.is_file():
        raise ValueError(f"no schema file at {path}")
    if file.suffix == ".json":
        return from_document(json.loads(file.read_text()))
    spec = importlib.util.spec_from_file_location(f"_schema_{file.stem}", file)
    if spec is None or spec.loader is None:
        raise ValueError(f"{path} is neither a Python file nor JSON")
    beside = str(file.resolve().parent)
    sys.path.insert(0, beside)
    try:
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
    finally:
        sys.path.remove(beside)
    found = getattr(module, "SCHEMA", None)
    if not isinstance(found, Schema):
        raise ValueError(f"{path} doesn't define SCHEMA = Schema(...)")
    return found


def from_document(document: dict) -> Schema:
    known = {"numeric", "categorical", "target", "positive", "negative", "stratify", "levels"}
    odd = set(document) - known
    if odd or not known - {"levels"} <= set(document):
        raise ValueError(f"a schema has {', '.join(sorted(known))}; here: {', '.join(sorted(document))}")
    numeric = {c: tuple(e) for c, e in document["numeric"].items()}
    categorical = {c: tuple(map(str, v)) for c, v in document["categorical"].items()}
    return Schema(**document | {"numeric": numeric, "categorical": categorical, "levels": tuple(map(tuple, document.get("levels", ())))})


def to_document(schema: Schema) -> dict:
    return {
        "numeric": {c: list(e) for c, e in schema.numeric.items()}, "categorical": {c: list(v) for c, v in schema.categorical.items()},
        "target": schema.target, "positive": schema.positive, "negative": schema.negative, "stratify": schema.stratify, "levels": [list(x) for x in schema.levels],
    }
