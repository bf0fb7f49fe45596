"""The five kinds of specification as field tables, and the parser that reads documents against them.

A table maps each field to a reader and a default; a reader turns a raw value into a checked one or raises SpecError. Unknown
keys are errors. A kind's cross-field requirements are a list of (requirement, message) pairs.
"""

from __future__ import annotations

import hashlib
import json
from datetime import date, datetime

REQUIRED = object()
DEFAULT_VERSION = "0.1.0"


class SpecError(ValueError):
    """A document that does not have the shape of its kind; ``where`` is the dotted path."""

    def __init__(self, where: str, problem: str):
        super().__init__(f"{where or 'document'}: {problem}")
        self.where, self.problem = where, problem


# ---- readers ----


def text(least: int = 0):
    def read(value, where):
        if not isinstance(value, str):
            raise SpecError(where, "text expected")
        if len(value) < least:
            raise SpecError(where, f"at least {least} characters expected")
        return value

    return read


def number(ge=None, gt=None, lt=None):
    def read(value, where):
        if isinstance(value, str):
            try:
                value = float(value)
            except ValueError:
                raise SpecError(where, "number expected") from None
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise SpecError(where, "number expected")
        value = float(value)
        if ge is not None and not value >= ge or gt is not None and not value > gt or lt is not None and not value < lt:
            raise SpecError(where, f"{value} is out of range")
        return value

    return read


def integer(ge=None):
    def read(value, where):
        if isinstance(value, str) and value.strip().lstrip("+-").isdigit():
            value = int(value)
        if isinstance(value, bool) or isinstance(value, float) and value.is_integer():
            value = int(value)
        if not isinstance(value, int):
            raise SpecError(where, "integer expected")
        if ge is not None and value < ge:
            raise SpecError(where, f"at least {ge} expected")
        return value

    return read


def flag(value, where):
    known = {True: True, False: False, "true": True, "false": False, "yes": True, "no": False, "on": True, "off": False, "1": True, "0": False}
    key = value.lower() if isinstance(value, str) else value
    if not isinstance(key, (bool, int, str)) or key not in known:
        raise SpecError(where, "true or false expected")
    return known[key]


def day(value, where):
    if isinstance(value, datetime):
        value = value.date()
    if isinstance(value, date):
        return value
    try:
        return date.fromisoformat(value)
    except (TypeError, ValueError):
        raise SpecError(where, "ISO date expected") from None


def one_of(*options: str):
    def read(value, where):
        if value not in options or not isinstance(value, str):
            raise SpecError(where, f"one of {', '.join(options)} expected")
        return value

    read.options = options
    return read


def mapping(value, where):
    if not isinstance(value, dict) or not all(isinstance(k, str) for k in value):
        raise SpecError(where, "mapping with text keys expected")
    return dict(value)


def anything(value, where):
    return value


def layer(value, where):
    return "last" if value == "last" else integer(0)(value, where)


def items(reader):
    def read(value, where):
        if not isinstance(value, (list, tuple)):
            raise SpecError(where, "list expected")
        return [reader(v, f"{where}[{k}]") for k, v in enumerate(value)]

    return read


def part(name: str):
    def read(value, where):
        return value if isinstance(value, Spec) else parse(name, value, where)

    return read


# ---- fixed values: vocabularies of the format ----

SOURCE_TYPES = one_of("database", "repository", "publication", "internal", "url")
FILTER_OPS = one_of("eq", "ne", "lt", "le", "gt", "ge", "in", "not_in", "contains", "not_contains", "between", "regex", "exists")
REDUNDANCY_METHODS = one_of("none", "sequence_identity", "cluster", "custom")
FIELD_TYPES = one_of("float", "int", "bool", "str", "category")
TABLE_FORMATS = one_of("csv", "parquet", "jsonl", "fasta", "hdf5", "other")
LEAKAGE_TYPES = one_of("sequence_identity", "embedding_similarity", "group_overlap", "exact_duplicate", "custom")
LEAKAGE_SCOPES = one_of("train_test", "train_val", "val_test", "all")
IDENTITY_MEASURES = one_of("sequence_identity", "embedding_similarity", "cluster_label", "time", "structure")
PROTOCOLS = one_of("random", "stratified", "group", "cluster_aware", "temporal", "structure_aware", "custom")
VECTOR_FORMATS = one_of("npy", "npz", "pt", "parquet", "hdf5", "other")

# ---- field tables: name -> (reader, default); a default of None makes the field optional ----

TABLES: dict[str, dict] = {
    "source": {"type": (SOURCE_TYPES, REQUIRED), "name": (text(1), REQUIRED), "identifier": (text(), None), "version": (text(), None), "accessed": (day, None), "uri": (text(), None)},
    "filter": {"field": (text(1), REQUIRED), "op": (FILTER_OPS, REQUIRED), "value": (anything, None), "description": (text(), None)},
    "redundancy": {"method": (REDUNDANCY_METHODS, REQUIRED), "threshold": (number(), None), "tool": (text(), None), "parameters": (mapping, dict)},
    "label": {"name": (text(1), REQUIRED), "dtype": (FIELD_TYPES, REQUIRED), "description": (text(), None), "unit": (text(), None)},
    "metadata": {"name": (text(1), REQUIRED), "dtype": (FIELD_TYPES, REQUIRED), "required": (flag, False), "description": (text(), None)},
    "dataset_output": {"format": (TABLE_FORMATS, REQUIRED), "path": (text(1), REQUIRED), "checksum": (text(), None)},
    "dataset": {
        "name": (text(1), REQUIRED), "description": (text(), None), "domain": (text(), "protein"), "created_by": (text(), None), "created_at": (day, None),
        "sources": (items(part("source")), list), "filters": (items(part("filter")), list), "redundancy_control": (part("redundancy"), lambda: parse("redundancy", {"method": "none"})),
        "labels": (items(part("label")), list), "metadata": (items(part("metadata")), list), "sequence_field": (text(), "sequence"), "id_field": (text(), "id"), "output": (part("dataset_output"), None),
    },
    "leakage_check": {"type": (LEAKAGE_TYPES, REQUIRED), "scope": (LEAKAGE_SCOPES, "all"), "threshold": (number(), None), "field": (text(), None), "description": (text(), None)},
    "ratios": {"train": (number(gt=0, lt=1), REQUIRED), "val": (number(ge=0, lt=1), REQUIRED), "test": (number(gt=0, lt=1), REQUIRED)},
    "identity": {"measure": (IDENTITY_MEASURES, REQUIRED), "threshold": (number(), None), "tool": (text(), None), "parameters": (mapping, dict)},
    "split": {
        "split_name": (text(1), REQUIRED), "protocol": (PROTOCOLS, REQUIRED), "ratios": (part("ratios"), REQUIRED), "seed": (integer(), REQUIRED), "stratify_field": (text(), None), "group_field": (text(), None),
        "identity": (part("identity"), None), "time_field": (text(), None), "leakage_checks": (items(part("leakage_check")), list), "notes": (text(), None),
    },
    "tokenization": {"max_length": (integer(1), 1024), "truncation": (flag, True), "padding": (one_of("none", "max_length", "longest"), "none"), "add_special_tokens": (flag, True)},
    "embedding_output": {"format": (VECTOR_FORMATS, "npz"), "path": (text(1), REQUIRED), "checksum": (text(), None)},
    "embedding": {
        "name": (text(1), REQUIRED), "model_id": (text(1), REQUIRED), "provider": (one_of("huggingface", "facebook", "local", "custom"), None), "tokenization": (part("tokenization"), lambda: parse("tokenization", {})),
        "layer": (layer, "last"), "pooling": (one_of("mean", "cls", "sum", "attention", "custom"), "mean"), "dtype": (one_of("fp32", "fp16", "bf16"), "fp32"), "device": (one_of("cpu", "cuda", "mps", "tpu", "other"), "cpu"),
        "batch_size": (integer(1), 8), "seed": (integer(), None), "parameters": (mapping, dict), "input_dataset_fingerprint": (text(), None), "output": (part("embedding_output"), None),
    },
    "cross_validation": {"enabled": (flag, False), "folds": (integer(2), 5), "strategy": (one_of("kfold", "stratified_kfold", "group_kfold", "time_series", "custom"), "kfold"), "group_field": (text(), None), "parameters": (mapping, dict)},
    "calibration": {"enabled": (flag, False), "method": (one_of("platt", "isotonic", "temperature", "custom"), "platt"), "parameters": (mapping, dict)},
    "train_output": {"model_path": (text(), None), "metrics_path": (text(), None), "predictions_path": (text(), None), "checkpoint_dir": (text(), None)},
    "train": {
        "name": (text(1), REQUIRED), "task": (one_of("classification", "regression", "ranking", "unsupervised"), REQUIRED), "model_family": (one_of("linear", "rf", "svm", "xgb", "nn", "gdl", "custom"), REQUIRED), "model_id": (text(), None),
        "hyperparams": (mapping, dict), "metrics": (items(text()), list), "seed": (integer(), 42), "early_stopping": (mapping, None), "cross_validation": (part("cross_validation"), None), "calibration": (part("calibration"), None),
        "parameters": (mapping, dict), "input_split_fingerprint": (text(), None), "input_embedding_fingerprint": (text(), None), "output": (part("train_output"), None),
    },
    "dependencies": {"strategy": (one_of("lockfile", "pip_freeze", "conda_env", "poetry_lock", "uv_lock", "custom"), "pip_freeze"), "reference": (text(1), REQUIRED), "checksum": (text(), None)},
    "hardware": {"cpu": (text(), None), "gpu": (text(), None), "accelerator": (one_of("cuda", "mps", "tpu", "none", "other"), "none"), "ram_gb": (number(ge=0), None), "notes": (text(), None)},
    "container": {"type": (one_of("docker", "singularity", "apptainer", "none", "other"), "none"), "image": (text(), None), "digest": (text(), None)},
    "execution": {
        "name": (text(1), REQUIRED), "python_version": (text(1), REQUIRED), "platform": (text(), None), "git_commit": (text(), None), "working_directory": (text(), None), "dependencies": (part("dependencies"), REQUIRED),
        "hardware": (part("hardware"), None), "container": (part("container"), None), "determinism_flags": (mapping, dict), "notes": (text(), None),
    },
}

#: The kinds that stand in a file of their own; they also carry a format version.
KINDS = ("dataset", "split", "embedding", "train", "execution")
#: Optional fields in which an explicit null is an error although the default is not null.
NULLABLE_DEFAULTS = {("dataset", "domain"), ("hardware", "accelerator")}
SIMILAR = ("sequence_identity", "embedding_similarity")


def _in_unit(x) -> bool:
    return x is not None and 0 <= x <= 1


def _unique(names) -> bool:
    return len(set(names)) == len(names)


#: Cross-field requirements: (holds for the spec, problem otherwise).
REQUIREMENTS: dict[str, list] = {
    "redundancy": [(lambda s: s.method not in ("sequence_identity", "cluster") or _in_unit(s.threshold), "threshold in 0..1 required by the method")],
    "dataset": [
        (lambda s: s.sources, "at least one source required"),
        (lambda s: _unique([x.name for x in s.labels]), "label names repeat"),
        (lambda s: _unique([x.name for x in s.metadata]), "metadata names repeat"),
        (
            lambda s: not {s.id_field, s.sequence_field} & {x.name for x in [*s.labels, *s.metadata]},
            "a label or metadata field has the name of the id or sequence field"
        ),
    ],
    "leakage_check": [
        (lambda s: s.type not in SIMILAR or _in_unit(s.threshold), "threshold in 0..1 required by the type"),
        (lambda s: s.type != "group_overlap" or s.field, "field required by group_overlap"),
    ],
    "ratios": [(lambda s: abs(s.train + s.val + s.test - 1) <= 1e-6, "ratios must sum to 1")],
    "identity": [(lambda s: s.measure not in SIMILAR or _in_unit(s.threshold), "threshold in 0..1 required by the measure")],
    "split": [
        (lambda s: s.protocol != "stratified" or s.stratify_field, "stratify_field required"),
        (lambda s: s.protocol != "group" or s.group_field, "group_field required"),
        (lambda s: s.protocol not in ("cluster_aware", "structure_aware") or s.identity is not None, "identity required"),
        (lambda s: s.protocol != "cluster_aware" or s.identity.measure in (*SIMILAR, "cluster_label"), "identity.measure does not define clusters"),
        (lambda s: s.protocol != "temporal" or s.time_field, "time_field required"),
        (lambda s: s.protocol == "random" or s.leakage_checks, "leakage_checks required by a protocol other than random"),
    ],
    "embedding": [
        (lambda s: s.tokenization.padding != "max_length" or s.tokenization.truncation, "padding to max_length requires truncation"),
        (lambda s: s.output is None or s.output.path.strip(), "output.path is blank"),
    ],
    "train": [
        (lambda s: s.task == "unsupervised" or s.metrics, "metrics required by a supervised task"),
        (lambda s: not (s.calibration and s.calibration.enabled) or s.task == "classification", "calibration is for classification only"),
        (
            lambda s: not (
                s.cross_validation and s.cross_validation.enabled and s.cross_validation.strategy == "group_kfold"
            ) or s.cross_validation.group_field,
            "cross_validation.group_field required by group_kfold"
        ),
    ],
    "execution": [(lambda s: s.container is None or s.container.type == "none" or not s.container.image or s.container.digest, "container.digest required by an image")],
}


#: How a split says what it goes by.
_USING = " using {measure}{limit}"
REGIMES = {
    "stratified": " stratified by '{stratify_field}'", "group": " grouped by '{group_field}'", "temporal": " ordered by '{time_field}'",
    "cluster_aware": _USING, "structure_aware": _USING
}


class Spec:
    """A checked document. Fields are attributes; assigning one is not checked again."""

    def __init__(self, kind: str, values: dict, version_key: str | None = None):
        self.kind, self.version_key = kind, version_key
        self.__dict__.update(values)
        self._fields = list(values)

    def to_dict(self) -> dict:
        """JSON values; fields that are null are left out, nulls inside free-form mappings stay."""
        return {k: v for k in self._fields if (v := _plain(getattr(self, k))) is not None}

    def fingerprint(self) -> str:
        return hashlib.sha256(canonical_json(self.to_dict()).encode()).hexdigest()

    @property
    def format_version(self):
        return getattr(self, self.version_key) if self.version_key else None

    def __eq__(self, other):
        return isinstance(other, Spec) and (self.kind, self.to_dict()) == (other.kind, other.to_dict())

    def __repr__(self):
        return f"Spec({self.kind}: {self.to_dict()})"

    def describe_regime(self) -> str:
        """One line about a split."""
        by = REGIMES.get(self.protocol, "")
        shown = {k: v for k in ("stratify_field", "group_field", "time_field") if (v := getattr(self, k)) is not None}
        if self.identity:
            shown["measure"] = self.identity.measure
            shown["limit"] = f" (threshold={self.identity.threshold})" if self.identity.threshold is not None else ""
        return f"{self.protocol} split" + (by.format(**shown) if all(f"{{{k}}}" not in by for k in ("measure", "limit") if k not in shown) else "")


def _plain(value):
    if isinstance(value, Spec):
        return value.to_dict()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return value


def canonical_json(value) -> str:
    """Sorted keys, no spaces, characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def parse(kind: str, document, where: str = "") -> Spec:
    """Reads a mapping as a spec of ``kind``. A top-level kind's format version may stand under any key <name>_version."""
    if not isinstance(document, dict):
        raise SpecError(where, "mapping expected")
    table, values, version_key = TABLES[kind], {}, None
    rest = dict(document)
    if kind in KINDS:
        version_key = next((k for k in rest if str(k).endswith("_version") and k not in table), "spec_version")
        version = rest.pop(version_key, DEFAULT_VERSION)
        values[version_key] = text()(version, _at(where, version_key))
        if not version.strip():
            raise SpecError(_at(where, version_key), "blank version")
    for name, (reader, default) in table.items():
        if name not in rest:
            if default is REQUIRED:
                raise SpecError(_at(where, name), "required")
            values[name] = default() if callable(default) else default
            continue
        value = rest.pop(name)
        nullable = default is None or (kind, name) in NULLABLE_DEFAULTS
        values[name] = None if value is None and nullable else reader(value, _at(where, name))
    if rest:
        raise SpecError(where, f"unknown keys: {', '.join(sorted(map(str, rest)))}")
    spec = Spec(kind, values, version_key)
    for holds, problem in REQUIREMENTS.get(kind, ()):
        if not holds(spec):
            raise SpecError(where or kind, problem)
    return spec


def _at(where: str, name: str) -> str:
    return f"{where}.{name}" if where else str(name)
