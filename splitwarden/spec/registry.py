"""A content-addressed registry: JSON files on the driver, and put-if-absent over tables."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame

from .provenance import Record
from .schema import KINDS, Spec


class Registry:
    """specs/<kind>/<fingerprint>.json, runs/<run_id>.json and artifacts/<run_id>/<kind>/<name> below a folder.

    Writes go to a temporary name first, so a reader never sees half a file.
    """

    def __init__(self, root):
        self.root = Path(root)
        for name in ("specs", "runs", "artifacts"):
            (self.root / name).mkdir(parents=True, exist_ok=True)

    def _put(self, path: Path, value: dict, overwrite: bool) -> bool:
        if path.exists() and not overwrite:
            return False
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_suffix(f".{os.getpid()}.part")
        part.write_text(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False), encoding="utf-8")
        part.replace(path)
        return True

    def put_spec(self, spec: Spec, overwrite: bool = False) -> tuple[Path, bool]:
        """The file of the spec, and whether it was written now."""
        path = self.root / "specs" / spec.kind / f"{spec.fingerprint()}.json"
        return path, self._put(path, spec.to_dict(), overwrite)

    def put_run(self, record: Record, overwrite: bool = False) -> tuple[Path, bool]:
        path = self.root / "runs" / f"{record.run_id}.json"
        return path, self._put(path, record.to_dict(), overwrite)

    def load_run(self, run_id: str) -> dict:
        path = self.root / "runs" / f"{run_id}.json"
        if not path.exists():
            raise FileNotFoundError(f"no run {run_id} in {self.root}")
        return json.loads(path.read_text(encoding="utf-8"))

    def put_artifact(self, run_id: str, artifact: dict, mode: str = "reference", overwrite: bool = False) -> Path:
        """Where the artifact belongs; ``copy`` and ``symlink`` also put it there. A name taken by another path gets a suffix."""
        if mode not in ("reference", "copy", "symlink"):
            raise ValueError(f"unknown mode {mode}")
        source = Path(artifact["path"])
        folder = self.root / "artifacts" / run_id / artifact["kind"]
        folder.mkdir(parents=True, exist_ok=True)
        owners = folder / ".owners.json"
        known = json.loads(owners.read_text()) if owners.exists() else {}
        name = source.name
        if known.get(name, str(source)) != str(source):
            name = f"{source.stem}-{hashlib.sha256(str(source).encode()).hexdigest()[:8]}{source.suffix}"
        target = folder / name
        if mode != "reference":
            if not source.exists():
                raise FileNotFoundError(str(source))
            there = target.exists() or target.is_symlink()
            if there and not overwrite:
                return target
            if there:
                shutil.rmtree(target) if target.is_dir() and not target.is_symlink() else target.unlink()
            if mode == "symlink":
                target.symlink_to(source.resolve())
            else:
                (shutil.copytree if source.is_dir() else shutil.copy2)(source, target)
        owners.write_text(json.dumps(known | {name: str(source)}))
        return target

    def put_artifacts(self, record: Record, mode: str = "reference", overwrite: bool = False) -> dict[str, Path]:
        return {f"{a['kind']}:{a['path']}": self.put_artifact(record.run_id, a, mode, overwrite) for a in record.artifacts}

    def put_all(self, specs: dict[str, Spec], record: Record, artifact_mode: str = "reference", overwrite: bool = False) -> dict:
        return {
            "specs": {k: self.put_spec(specs[k], overwrite)[0] for k in KINDS}, "run": self.put_run(record, overwrite)[0],
            "artifacts": self.put_artifacts(record, artifact_mode, overwrite)
        }


def put_if_absent(table: DataFrame, rows: DataFrame, key: list[str], overwrite: bool = False) -> DataFrame:
    """The table after the rows were put: a key that exists keeps its row, or gets the new one with ``overwrite``."""
    if overwrite:
        return table.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows)
    return table.unionByName(rows.join(table.select(*key).distinct(), key, "left_anti"))
