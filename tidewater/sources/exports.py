"""What runs leave for people: summaries as JSON and Markdown, a list of the files, and a log of what failed, on any file system. Small tables only: each is read whole."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession

from .store import Store


def json_ready(value: Any) -> Any:
    """Rows and nested values as JSON takes them: what is not finite becomes null, dates their text."""
    if isinstance(value, Row):
        value = value.asDict()
    if isinstance(value, dict):
        return {str(k): json_ready(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_ready(v) for v in value]
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return value if value is None or isinstance(value, (str, bool, int)) else str(value)


def write_summary(df: DataFrame, path: str) -> dict:
    """A table of one row as a JSON file, its nested parts as they are, and beside it a CSV with dotted names."""
    row = df.first()
    summary = json_ready(row) if row else {}
    store = Store(df.sparkSession, path)
    store.write_text(path, json.dumps(summary, indent=2, sort_keys=True))

    def flat(x: dict, at: str = ""):
        for k, v in x.items():
            if isinstance(v, dict):
                yield from flat(v, f"{at}{k}.")
            else:
                yield f"{at}{k}", v

    cells = dict(flat(summary))
    quote = lambda v: '"' + str("" if v is None else v).replace('"', '""') + '"'
    store.write_text(os.path.splitext(path)[0] + ".csv", ",".join(map(quote, cells)) + "\n" + ",".join(map(quote, cells.values())) + "\n")
    return summary


def write_markdown(spark: SparkSession, title: str, sections: dict[str, DataFrame | dict], path: str, most: int = 50) -> None:
    """A report with a table for each section, of at most `most` rows; a note says where there are more."""
    lines = [f"# {title}", ""]
    for name, part in sections.items():
        rows = [part] if isinstance(part, dict) else [r.asDict() for r in part.limit(most + 1).collect()]
        lines += [f"## {name}", ""]
        if rows:
            lines += ["| " + " | ".join(rows[0]) + " |", "|" + " --- |" * len(rows[0])]
            lines += ["| " + " | ".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|") for v in r.values()) + " |" for r in rows[:most]]
        lines += ["", "and more", ""] if len(rows) > most else [""]
    Store(spark, path).write_text(path, "\n".join(lines))


def write_manifest(spark: SparkSession, folder: str, layers: list[tuple[str, str]] = ()) -> list[dict]:
    """manifest.json and manifest.md in a folder: its files and tables (folders of parts) with their kind and size, and what its layers are for."""
    store = Store(spark, folder)
    found = [{"file": n, "suffix": "table" if table else os.path.splitext(n)[1].lstrip("."), "size_bytes": size} for n, size, table in store.names(folder) if not n.startswith(("manifest.", ".", "_"))]
    store.write_text(f"{folder}/manifest.json", json.dumps({"layers": [{"layer": a, "role": b} for a, b in layers], "files": found}, indent=2))
    store.write_text(f"{folder}/manifest.md", "# Files\n\n" + "".join(f"- {a}: {b}\n" for a, b in layers) + "\n" + "".join(f"- `{x['file']}` ({x['size_bytes']} bytes)\n" for x in found))
    return found


def safely(spark: SparkSession, folder: str, name: str, export: Callable[[], Any]) -> dict:
    """Runs an export; what it raises goes to errors.jsonl in the folder, and the others go on."""
    try:
        export()
        return {"layer": name, "status": "ok"}
    except Exception as e:
        error = {"layer": name, "status": "error", "error": str(e)[:2000]}
        store, path = Store(spark, folder), f"{folder}/errors.jsonl"
        store.write_text(path, (store.read_text(path) if store.exists(path) else "") + json.dumps(error, sort_keys=True) + "\n")
        return error
