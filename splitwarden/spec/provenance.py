"""Run identity and provenance records."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from .schema import DEFAULT_VERSION, KINDS, Spec, canonical_json


def compute_run_id(fingerprints: dict[str, str], salt: str | None = None) -> str:
    """sha256 of the five fingerprints and the salt, which stays as null where unset."""
    return hashlib.sha256(canonical_json({k: fingerprints[k] for k in KINDS} | {"salt": salt}).encode()).hexdigest()


@dataclass
class Record:
    """What a run used and made. ``artifacts`` are mappings with kind, path and optional format, checksum, description."""

    run_id: str
    fingerprints: dict
    names: dict = field(default_factory=dict)
    artifacts: list = field(default_factory=list)
    metrics: dict = field(default_factory=dict)
    notes: str | None = None
    extra: dict = field(default_factory=dict)
    created_at_utc: str = field(default_factory=lambda: datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
    format_version: str = DEFAULT_VERSION

    def __post_init__(self):
        if len(self.run_id) < 16:
            raise ValueError("run_id has fewer than 16 characters")
        if missing := [k for k in KINDS if not (self.fingerprints.get(k) or "").strip()]:
            raise ValueError(f"fingerprints missing: {', '.join(missing)}")
        for a in self.artifacts:
            self._check(a)

    @staticmethod
    def _check(artifact: dict) -> None:
        if not artifact.get("kind") or not artifact.get("path"):
            raise ValueError("an artifact needs a kind and a path")
        if extra := set(artifact) - {"kind", "path", "format", "checksum", "description"}:
            raise ValueError(f"unknown artifact keys: {', '.join(sorted(extra))}")

    @classmethod
    def from_specs(cls, specs: dict[str, Spec], salt: str | None = None, **more) -> Record:
        prints = {k: specs[k].fingerprint() for k in KINDS}
        names = {k: specs[k].split_name if k == "split" else specs[k].name for k in KINDS}
        version = specs["dataset"].format_version or DEFAULT_VERSION
        return cls(compute_run_id(prints, salt), prints, names, format_version=version, **more)

    def add_artifact(self, kind: str, path: str, **more) -> Record:
        artifact = {"kind": kind, "path": path, **more}
        self._check(artifact)
        self.artifacts.append(artifact)
        return self

    def to_dict(self) -> dict:
        out = {"run_id": self.run_id, "created_at_utc": self.created_at_utc, "format_version": self.format_version}
        for k in KINDS:
            out[f"{k}_fingerprint"], out[f"{k}_name"] = self.fingerprints[k], self.names.get(k)
        out |= {
            "artifacts": [{k: v for k, v in a.items() if v is not None} for a in self.artifacts], "metrics": self.metrics, "notes": self.notes,
            "extra": self.extra
        }
        return {k: v for k, v in out.items() if v is not None}

    def fingerprint(self) -> str:
        """Covers created_at_utc too, so it differs between runs."""
        return hashlib.sha256(canonical_json(self.to_dict()).encode()).hexdigest()

    def to_json(self, indent: int = 2) -> str:
        return json.dumps(self.to_dict(), indent=indent, sort_keys=True, ensure_ascii=False)

    def save_json(self, path) -> Path:
        path = Path(path)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(self.to_json(), encoding="utf-8")
        return path
