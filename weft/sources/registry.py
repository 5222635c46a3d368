"""Known repositories and their index state: one JSON file each, and lookups in them."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path

FIELDS = ("name", "path", "storage_path", "indexed_at", "last_commit", "stats")


class Registry:
    """Rows of FIELDS in one JSON file; entries whose index is gone are dropped on reading."""

    def __init__(self, file: str | Path) -> None:
        self.file = Path(file)

    def _load(self) -> list[dict]:
        try:
            rows = json.loads(self.file.read_text(encoding="utf-8"))
        except (OSError, ValueError):
            return []
        return [r for r in rows if isinstance(r, dict) and r.get("name") and r.get("path")]

    def _save(self, rows: list[dict]) -> None:
        self.file.parent.mkdir(parents=True, exist_ok=True)
        draft = self.file.with_suffix(".tmp")
        draft.write_text(json.dumps(rows, indent=1), encoding="utf-8")
        draft.replace(self.file)

    def rows(self, validate: bool = True) -> list[dict]:
        found = self._load()
        alive = [r for r in found if Path(r.get("storage_path") or r["path"]).exists()] if validate else found
        if len(alive) < len(found):
            self._save(alive)
        return sorted(alive, key=lambda r: r["name"])

    def register(self, name: str, path: str, storage_path: str, last_commit: str | None, stats: dict) -> dict:
        row = dict(zip(FIELDS, (name, str(path), str(storage_path), datetime.now(UTC).isoformat(), last_commit, stats), strict=True))
        self._save([r for r in self._load() if r["path"] != str(path)] + [row])
        return row

    def unregister(self, path: str) -> None:
        self._save([r for r in self._load() if r["path"] != str(path)])

    def find(self, key: str | None = None) -> dict:
        """By name without case, else by path, else by part of the name; without a key the only one. Anything else is an error."""
        rows = self.rows()
        if not rows:
            raise LookupError("no repository is indexed")
        if key is None:
            if len(rows) > 1:
                raise LookupError("several repositories: " + ", ".join(r["name"] for r in rows))
            return rows[0]
        for fit in (lambda r: r["name"].lower() == key.lower(), lambda r: r["path"] == str(Path(key).resolve()), lambda r: key.lower() in r["name"].lower()):
            hit = [r for r in rows if fit(r)]
            if len(hit) == 1:
                return hit[0]
            if hit:
                raise LookupError(f"{key} is ambiguous: " + ", ".join(r["name"] for r in hit))
        raise LookupError(f"no repository {key}; known: " + ", ".join(r["name"] for r in rows))

    def for_folder(self, folder: str) -> dict | None:
        """The repository with the longest path that the folder lies in."""
        here = Path(folder).resolve()
        hit = [r for r in self.rows() if here == Path(r["path"]) or Path(r["path"]) in here.parents]
        return max(hit, key=lambda r: len(r["path"]), default=None)


class Status:
    """State of a running analysis, as one JSON file."""

    def __init__(self, file: str | Path) -> None:
        self.file = Path(file)

    def write(self, run_id: str, phase: str, percent: int, status: str = "running", **more) -> None:
        self.file.parent.mkdir(parents=True, exist_ok=True)
        self.file.write_text(json.dumps({"run_id": run_id, "status": status, "phase": phase, "percent": percent, "at": datetime.now(UTC).isoformat(), **more}), encoding="utf-8")

    def read(self) -> dict | None:
        try:
            return json.loads(self.file.read_text(encoding="utf-8"))
        except (OSError, ValueError):
            return None
