"""Run bundles: a folder with a manifest, tables and texts."""

from __future__ import annotations

import datetime as dt
import json
from pathlib import Path

from pyspark.sql import DataFrame, Row

from ..functions.ids import mint_stamped


def jsonable(value: object) -> object:
    """Plain JSON values of rows, dates, sets and numpy numbers."""
    if isinstance(value, Row):
        return jsonable(value.asDict(recursive=True))
    if isinstance(value, dict):
        return {str(k): jsonable(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [jsonable(v) for v in value]
    if isinstance(value, (set, frozenset)):
        return sorted(map(jsonable, value), key=str)
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    return value.item() if hasattr(value, "item") else value


class Bundle:
    """Collects sections and small tables of one run in a folder on the driver."""

    def __init__(self, folder: str | Path, kind: str, prefix: str = "RUN") -> None:
        self.obj_id, self.folder = mint_stamped(prefix, kind), Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)
        self.manifest: dict = {"obj_id": self.obj_id, "kind": kind, "sections": {}, "files": []}

    def section(self, name: str, payload: object) -> None:
        """A section; a second dictionary of the same name is merged into the first."""
        old, new = self.manifest["sections"].get(name), jsonable(payload)
        self.manifest["sections"][name] = old | new if isinstance(old, dict) and isinstance(new, dict) else new

    def write_table(self, name: str, rows: DataFrame, role: str = "table", most: int = 100_000) -> Path:
        """A CSV side file; larger tables belong in storage of their own."""
        path = self.folder / f"{name}.csv"
        got = rows.limit(most + 1).toPandas()
        if len(got) > most:
            raise ValueError(f"table {name} has more than {most} rows")
        got.to_csv(path, index=False)
        self.manifest["files"].append({"path": path.name, "role": role, "rows": len(got)})
        return path

    def write_text(self, name: str, text: str, role: str = "text") -> Path:
        path = self.folder / name
        path.write_text(text)
        self.manifest["files"].append({"path": name, "role": role})
        return path

    def close(self) -> Path:
        path = self.folder / "manifest.json"
        path.write_text(json.dumps(self.manifest, indent=1, sort_keys=True))
        return path


def read_manifest(folder: str | Path) -> dict:
    return json.loads((Path(folder) / "manifest.json").read_text())


def describe(folder: str | Path) -> str:
    m = read_manifest(folder)
    return f"{m['obj_id']}: {m['kind']}, sections {', '.join(sorted(m['sections'])) or 'none'}, {len(m['files'])} files"
