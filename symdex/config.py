"""Settings of a user as a small JSON file: where indexes are kept."""

from __future__ import annotations

import json
import os
import warnings
from pathlib import Path

FOLDER = ".symdex"


def _path(home: str | Path | None) -> Path:
    return Path(home or Path.home()) / FOLDER / "config.json"


def defaults(home: str | Path | None = None) -> dict:
    return {"local_path": str(Path(home or Path.home()) / FOLDER)}


def load(home: str | Path | None = None) -> dict:
    """The settings; the defaults where there are none, or where they can't be read or lack `local_path`."""
    path = _path(home)
    if not path.exists():
        return defaults(home)
    try:
        data = json.loads(path.read_text("utf-8"))
    except (OSError, ValueError):
        warnings.warn(f"{path} can't be read; the defaults hold", stacklevel=2)
        return defaults(home)
    return data if isinstance(data, dict) and "local_path" in data else defaults(home)


def save(values: dict, home: str | Path | None = None) -> None:
    """Put values over what is saved. A broken file is kept aside under another name."""
    path = _path(home)
    path.parent.mkdir(parents=True, exist_ok=True)
    known: dict = {}
    if path.exists():
        try:
            known = json.loads(path.read_text("utf-8"))
        except (OSError, ValueError):
            os.replace(path, path.with_suffix(".json.corrupted"))
    draft = path.with_suffix(".draft")
    draft.write_text(json.dumps(known | values, indent=2) + "\n", "utf-8")
    os.replace(draft, path)


def clear(home: str | Path | None = None) -> None:
    _path(home).unlink(missing_ok=True)


def base_folder(home: str | Path | None = None) -> Path:
    """Where indexes are kept, made if need be."""
    path = Path(load(home)["local_path"]).expanduser().resolve()
    path.mkdir(parents=True, exist_ok=True)
    return path
