"""Configuration of a laboratory: JSON with overrides; keys it does not know are kept."""

from __future__ import annotations

import json
from pathlib import Path

DEFAULTS: dict = {"plate_format": 96, "fill_order": "column", "sequencing_form": "genewiz", "vendor": "idt_eblocks", "instruments": {}}


def load(path: str | Path | None = None, **overrides) -> dict:
    """Defaults, then the file if there is one, then overrides. A file that is no JSON is an error."""
    found: dict = {}
    if path is not None and Path(path).exists():
        try:
            found = json.loads(Path(path).read_text())
        except json.JSONDecodeError as error:
            raise ValueError(f"{path} is no JSON: {error}") from error
    return DEFAULTS | found | {k: v for k, v in overrides.items() if v is not None}


def write(lab: dict, path: str | Path) -> None:
    Path(path).write_text(json.dumps(lab, indent=1, sort_keys=True))


def instrument_for(job: str, lab: dict, override: str | None = None) -> str:
    if override:
        return override
    if job not in lab.get("instruments", {}):
        raise KeyError(f"no instrument for {job}: name one or put it into the configuration")
    return lab["instruments"][job]
