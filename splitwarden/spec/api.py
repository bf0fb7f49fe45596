"""One call for each step from a folder of YAML files to a registered run."""

from __future__ import annotations

from pathlib import Path

from .provenance import Record
from .registry import Registry
from .rules import Issue, check_pack, format_issues
from .schema import KINDS, Spec, parse


def load_yaml(path) -> dict:
    """The mapping in a file; an empty file is an empty mapping."""
    import yaml

    found = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} does not hold a mapping")
    return found


def load_specs(directory, **files: str) -> dict[str, Spec]:
    """The five specs of a folder; ``files`` gives names other than <kind>.yaml, such as train='train_regression.yaml'."""
    if other := set(files) - set(KINDS):
        raise TypeError(f"unknown kinds: {', '.join(sorted(other))}")
    return {k: parse(k, load_yaml(Path(directory) / files.get(k, f"{k}.yaml"))) for k in KINDS}


def validate_specs(specs: dict[str, Spec], strict: bool = False) -> list[Issue]:
    """Sorted issues; with ``strict``, errors raise ValueError."""
    issues = check_pack(**specs)
    errors = [i for i in issues if i.severity == "ERROR"]
    if strict and errors:
        raise ValueError("the pack has errors:\n" + format_issues(errors))
    return issues


def validate_files(strict: bool = False, **paths) -> list[Issue]:
    """Issues of some or all kinds, such as dataset=..., split=...; ERROR issues raise where strict."""
    return validate_specs({k: parse(k, load_yaml(p)) for k, p in paths.items()}, strict)


def create_record(specs: dict[str, Spec], salt: str | None = None, **more) -> Record:
    return Record.from_specs(specs, salt, **more)


def register_run(specs: dict[str, Spec], record: Record, registry, artifact_mode: str = "reference", overwrite: bool = False) -> dict:
    registry = registry if isinstance(registry, Registry) else Registry(registry)
    return registry.put_all(specs, record, artifact_mode, overwrite)


def run_pack(
    directory, registry, strict: bool = True, salt: str | None = None, artifacts: list | None = None, artifact_mode: str = "reference", overwrite: bool = False,
    metrics: dict | None = None, notes: str | None = None, **files: str
) -> dict:
    """Load, check, record and register a pack: {specs, issues, record, registry_paths}."""
    specs = load_specs(directory, **files)
    issues = validate_specs(specs, strict)
    record = create_record(specs, salt, artifacts=list(artifacts or []), metrics=dict(metrics or {}), notes=notes)
    return {"specs": specs, "issues": issues, "record": record, "registry_paths": register_run(specs, record, registry, artifact_mode, overwrite)}
