"""Specifications: shapes, rules, fingerprints, records, registry and lineage."""

import copy
import hashlib
import json

import pytest
import yaml

from splitwarden import spec as S
from splitwarden.spec.lineage import artifact_id
from splitwarden.spec.registry import Registry
from splitwarden.spec.rules import RULES, check_alone
from splitwarden.spec.schema import canonical_json

DATASET = {
    "demo_version": "0.1.0", "name": "peptides", "sources": [{"type": "database", "name": "UniProt", "version": "2024_05", "accessed": "2024-06-01"}],
    "filters": [{"field": "sequence_length", "op": "between", "value": [50, 1000], "description": "length"}, {"field": "has_noncanonical", "op": "eq", "value": False, "description": "alphabet"}],
    "redundancy_control": {"method": "sequence_identity", "threshold": 0.9, "tool": "mmseqs2"}, "labels": [{"name": "fitness", "dtype": "float"}], "metadata": [{"name": "organism", "dtype": "str", "description": "source"}, {"name": "year", "dtype": "int"}],
    "output": {"format": "parquet", "path": "data/x.parquet", "checksum": "abc"},
}
SPLIT = {
    "split_name": "s", "protocol": "cluster_aware", "ratios": {"train": 0.8, "val": 0.1, "test": 0.1}, "seed": 42,
    "identity": {"measure": "sequence_identity", "threshold": 0.3}, "leakage_checks": [{"type": "exact_duplicate"}]
}
EMBEDDING = {"name": "e", "model_id": "m", "output": {"path": "e.npz", "checksum": "abc"}}
TRAIN = {
    "name": "t", "task": "regression", "model_family": "rf", "hyperparams": {"max_depth": None, "random_state": 1}, "metrics": ["rmse"],
    "output": {"metrics_path": "m.json"}
}
EXECUTION = {
    "name": "x", "python_version": "3.12", "git_commit": "abc", "dependencies": {"reference": "requirements.txt", "checksum": "c"},
    "hardware": {"accelerator": "none", "ram_gb": 64}, "determinism_flags": {"seed": 1}
}
BASE = {"dataset": DATASET, "split": SPLIT, "embedding": EMBEDDING, "train": TRAIN, "execution": EXECUTION}


def pack(**changes):
    """The base pack, with values changed at dotted paths: dataset__labels=[]."""
    documents = copy.deepcopy(BASE)
    for path, value in changes.items():
        *parents, last = path.split("__")
        at = documents
        for p in parents:
            at = at[int(p)] if isinstance(at, list) else at.setdefault(p, {})
        at[int(last) if isinstance(at, list) else last] = value
    return documents


def parsed(**changes):
    specs = {k: S.parse(k, d) for k, d in pack(**changes).items()}
    specs["embedding"].input_dataset_fingerprint = changes.get("embedding__input_dataset_fingerprint", specs["dataset"].fingerprint())
    specs["train"].input_split_fingerprint = changes.get("train__input_split_fingerprint", specs["split"].fingerprint())
    specs["train"].input_embedding_fingerprint = changes.get("train__input_embedding_fingerprint", specs["embedding"].fingerprint())
    return specs


def codes(specs):
    return {i.code for i in S.check_pack(**specs)}


def test_base_pack_is_silent():
    assert codes(parsed()) == set()


def test_rule_table_counts():
    assert len(RULES) == len({r.code for r in RULES}) == 70
    assert [sum(r.severity == s for r in RULES) for s in ("ERROR", "WARNING", "INFO")] == [25, 18, 27]


GROUP = {
    "split__protocol": "group", "split__group_field": "organism",
    "split__leakage_checks": [{"type": "group_overlap", "field": "organism"}, {"type": "exact_duplicate"}]
}
CHECK = [{"type": "exact_duplicate"}]
TRIGGERS = {
    "DATASET_SOURCE_UNVERSIONED": {"dataset__sources": [{"type": "url", "name": "u"}]},
    "DATASET_UNLABELED": {"dataset__labels": []},
    "DATASET_REQUIRED_META_NO_DESC": {"dataset__metadata__1__required": True},
    "DATASET_NO_OUTPUT": {"dataset__output": None},
    "DATASET_OUTPUT_EMPTY_PATH": {"dataset__output__path": " "},
    "DATASET_OUTPUT_NO_CHECKSUM": {"dataset__output__checksum": None},
    "FILTER_BETWEEN_SHAPE": {"dataset__filters__0__value": [1]},
    "FILTER_BETWEEN_NONE": {"dataset__filters__0__value": [1, None]},
    "FILTER_IN_TYPE": {"dataset__filters__0": {"field": "a", "op": "in", "value": "x", "description": "d"}},
    "FILTER_IN_EMPTY": {"dataset__filters__0": {"field": "a", "op": "not_in", "value": [], "description": "d"}},
    "FILTER_REGEX_EMPTY": {"dataset__filters__0": {"field": "a", "op": "regex", "value": " ", "description": "d"}},
    "FILTER_EXISTS_VALUE": {"dataset__filters__0": {"field": "a", "op": "exists", "value": "maybe", "description": "d"}},
    "FILTER_NO_DESC": {"dataset__filters__0__description": None},
    "REDUNDANCY_NONE": {"dataset__redundancy_control": {"method": "none"}},
    "REDUNDANCY_NO_TOOL": {"dataset__redundancy_control__tool": None},
    "REDUNDANCY_CUSTOM_UNSPECIFIED": {"dataset__redundancy_control": {"method": "custom"}},
    "SPLIT_SEED_NEGATIVE": {"split__seed": -1},
    "SPLIT_RANDOM_NO_CHECKS": {"split__protocol": "random", "split__leakage_checks": []},
    "SPLIT_GROUP_NO_GROUP_OVERLAP_CHECK": GROUP | {"split__leakage_checks": CHECK},
    "SPLIT_IDENTITY_THRESHOLD_HIGH": {"split__identity__threshold": 0.8},
    "SPLIT_NO_EXACT_DUP_CHECK": {"split__leakage_checks": [{"type": "custom"}]},
    "SPLIT_NO_VALIDATION_SET": {"split__ratios": {"train": 0.9, "val": 0, "test": 0.1}},
    "EMB_MODEL_ID_EMPTY": {"embedding__model_id": " "},
    "EMB_CLS_NO_SPECIAL_TOKENS": {"embedding__pooling": "cls", "embedding__tokenization": {"add_special_tokens": False}},
    "EMB_CPU_LARGE_BATCH": {"embedding__batch_size": 64},
    "EMB_NO_OUTPUT": {"embedding__output": None},
    "EMB_OUTPUT_NO_CHECKSUM": {"embedding__output__checksum": None},
    "EMB_NO_DATASET_LINK": {"embedding__input_dataset_fingerprint": None},
    "TRAIN_NEGATIVE_SEED": {"train__seed": -3},
    "TRAIN_UNSUP_WITH_METRICS": {"train__task": "unsupervised"},
    "TRAIN_NO_RANDOM_STATE_IN_HYPERPARAMS": {"train__hyperparams": {"a": 1}},
    "TRAIN_NO_OUTPUT": {"train__output": None},
    "TRAIN_OUTPUT_NO_METRICS_PATH": {"train__output": {"model_path": "m"}},
    "EXEC_PYTHON_VERSION_EMPTY": {"execution__python_version": " "},
    "EXEC_NO_GIT_COMMIT": {"execution__git_commit": None},
    "EXEC_DEPS_REF_EMPTY": {"execution__dependencies__reference": " "},
    "EXEC_DEPS_NO_CHECKSUM": {"execution__dependencies__checksum": None},
    "EXEC_CUDA_NO_GPU_NAME": {"execution__hardware__accelerator": "cuda", "embedding__device": "cuda"},
    "EXEC_NO_DETERMINISM_FLAGS": {"execution__determinism_flags": {}},
    "CONSIST_STRATIFY_UNKNOWN_FIELD": {"split__protocol": "stratified", "split__stratify_field": "zzz"},
    "CONSIST_GROUP_UNKNOWN_FIELD": GROUP | {"split__group_field": "zzz"},
    "CONSIST_TIME_UNKNOWN_FIELD": {"split__protocol": "temporal", "split__time_field": "zzz"},
    "CONSIST_GROUP_OVERLAP_UNKNOWN_FIELD": {"split__leakage_checks": [{"type": "group_overlap", "field": "zzz"}, *CHECK]},
    "CONSIST_NO_REDUNDANCY_WITH_IDENTITY_SPLIT": {"dataset__redundancy_control": {"method": "none"}},
    "CONSIST_SPLIT_THRESHOLD_GE_REDUNDANCY": {"dataset__redundancy_control__threshold": 0.3},
    "CONSIST_RANDOM_WITH_LABELS": {"split__protocol": "random"},
    "CONSIST_EMB_DATASET_FP_MISMATCH": {"embedding__input_dataset_fingerprint": "other"},
    "CONSIST_DATASET_NO_SEQUENCE_FIELD": {"dataset__sequence_field": " "},
    "CONSIST_TRAIN_SUPERVISED_NO_LABELS": {"dataset__labels": []},
    "CONSIST_TRAIN_SPLIT_FP_MISMATCH": {"train__input_split_fingerprint": "other"},
    "TRAIN_NO_SPLIT_LINK": {"train__input_split_fingerprint": None},
    "CONSIST_TRAIN_EMB_FP_MISMATCH": {"train__input_embedding_fingerprint": "other"},
    "TRAIN_NO_EMB_LINK": {"train__input_embedding_fingerprint": None},
    "CONSIST_NO_VAL_RECOMMEND_CV": {"split__ratios": {"train": 0.9, "val": 0, "test": 0.1}},
    "CONSIST_NO_GIT_COMMIT": {"execution__git_commit": None},
    "CONSIST_CUDA_EXEC_CPU_EMB": {"execution__hardware__accelerator": "cuda", "execution__hardware__gpu": "A"},
    "CONSIST_NONCUDA_EXEC_CUDA_EMB": {"embedding__device": "cuda"},
}
#: Rules that only a spec changed after parsing can break.
MUTATIONS = {
    "DATASET_NO_SOURCES": ("dataset", lambda s: setattr(s, "sources", [])),
    "EMB_MAXLEN_INVALID": ("embedding", lambda s: setattr(s.tokenization, "max_length", 0)),
    "EMB_PAD_MAXLEN_NO_TRUNC": ("embedding", lambda s: s.tokenization.__dict__.update(padding="max_length", truncation=False)),
    "EMB_OUTPUT_EMPTY_PATH": ("embedding", lambda s: setattr(s.output, "path", " ")),
    "SPLIT_NO_SEED": ("split", lambda s: setattr(s, "seed", None)),
    "SPLIT_NO_CHECKS_NONRANDOM": ("split", lambda s: setattr(s, "leakage_checks", [])),
    "SPLIT_IDENTITY_MISSING": ("split", lambda s: setattr(s, "identity", None)),
    "SPLIT_IDENTITY_THRESHOLD_MISSING": ("split", lambda s: setattr(s.identity, "threshold", None)),
    "SPLIT_TEMPORAL_NO_CHECKS": ("split", lambda s: s.__dict__.update(protocol="temporal", leakage_checks=[])),
    "TRAIN_NO_SEED": ("train", lambda s: setattr(s, "seed", None)),
    "TRAIN_CV_FOLDS_INVALID": ("train", lambda s: setattr(s, "cross_validation", S.parse("cross_validation", {"enabled": True})) or setattr(s.cross_validation, "folds", 1)),
    "CONSIST_GROUP_OVERLAP_NO_FIELD": ("split", lambda s: s.leakage_checks.append(S.parse("leakage_check", {"type": "group_overlap", "field": "x"})) or setattr(s.leakage_checks[-1], "field", None)),
    "CONSIST_NO_VAL_NO_TEST": ("split", lambda s: s.ratios.__dict__.update(val=0.0, test=0.0)),
}


def test_every_rule_has_a_trigger():
    assert set(TRIGGERS) | set(MUTATIONS) == {r.code for r in RULES}
    assert len(TRIGGERS) == 57 and len(MUTATIONS) == 13


@pytest.mark.parametrize("code", sorted(TRIGGERS))
def test_rule_fires(code):
    assert code in codes(parsed(**TRIGGERS[code]))


@pytest.mark.parametrize("code", sorted(MUTATIONS))
def test_rule_fires_after_mutation(code):
    specs = parsed()
    kind, change = MUTATIONS[code]
    change(specs[kind])
    assert code in codes(specs)


BROKEN = [
    ("dataset", "sources", []), (
        "dataset", "labels", [{"name": "a", "dtype": "int"}] * 2
    ), ("dataset", "labels", [{"name": "id", "dtype": "int"}]), ("dataset", "redundancy_control", {"method": "cluster"}), ("dataset", "color", 1),
    (
        "dataset", "redundancy_control", {"method": "cluster", "threshold": 1.5}
    ), ("dataset", "name", ""), ("dataset", "demo_version", " "), ("dataset", "created_at", "yesterday"), (
        "split", "ratios", {"train": 0.5, "val": 0.1, "test": 0.1}
    ),
    (
        "split", "ratios", {"train": 1.0, "val": 0.0, "test": 0.0}
    ), ("split", "identity", None), ("split", "identity", {"measure": "time"}), (
        "split", "identity", {"measure": "sequence_identity"}
    ), ("split", "leakage_checks", []),
    ("split", "leakage_checks", [{"type": "group_overlap"}]), (
        "split", "leakage_checks", [{"type": "sequence_identity"}]
    ), ("split", "protocol", "stratified"), ("split", "protocol", "group"), ("split", "protocol", "temporal"),
    ("split", "seed", "x"), ("embedding", "layer", -1), ("embedding", "layer", "first"), (
        "embedding", "tokenization", {"padding": "max_length", "truncation": False}
    ), ("embedding", "output", {"path": " "}), ("embedding", "batch_size", 0),
    ("train", "metrics", []), ("train", "calibration", {"enabled": True}), (
        "train", "cross_validation", {"enabled": True, "strategy": "group_kfold"}
    ), ("train", "cross_validation", {"folds": 1}), ("execution", "container", {"type": "docker", "image": "i"}),
    ("execution", "dependencies", {}), ("execution", "hardware", {"ram_gb": -1}),
]


@pytest.mark.parametrize("kind,field,value", BROKEN)
def test_structure_is_enforced(kind, field, value):
    with pytest.raises(S.SpecError):
        S.parse(kind, BASE[kind] | {field: value})


def test_fingerprint_ignores_order_and_nulls_but_not_values():
    a = S.parse("execution", EXECUTION)
    b = S.parse("execution", dict(reversed(EXECUTION.items())) | {"notes": None})
    assert a.fingerprint() == b.fingerprint()
    assert a.to_dict()["hardware"]["ram_gb"] == 64.0 and '"ram_gb":64.0' in canonical_json(a.to_dict())
    assert S.parse("train", TRAIN).to_dict()["hyperparams"] == {"max_depth": None, "random_state": 1}  # nulls in free-form values stay
    assert S.parse("dataset", DATASET | {"name": "é"}).fingerprint() == hashlib.sha256(
        json.dumps(S.parse("dataset", DATASET | {"name": "é"}).to_dict(), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
    ).hexdigest()


def test_frozen_fingerprints():
    got = {k: S.parse(k, d).fingerprint()[:12] for k, d in BASE.items()}
    assert got == FROZEN


FROZEN = {"dataset": "fe7df823b848", "embedding": "6453cdc9952a", "execution": "82f606f49a31", "split": "3f56776c85cd", "train": "0ad517cbe267"}


def test_layer_union():
    assert [S.parse("embedding", EMBEDDING | {"layer": v}).layer for v in ("last", 3, "3", 3.0, True)] == ["last", 3, 3, 3, 1]


def test_every_rule_has_a_hint():
    from splitwarden.spec.rules import HINTS, RULES

    assert {r.code for r in RULES} == set(HINTS)
    (issue,) = [i for i in S.validate_specs(parsed(dataset__labels=[])) if i.code == "DATASET_UNLABELED"]
    assert issue.hint == HINTS["DATASET_UNLABELED"] and f"(hint: {issue.hint})" in S.format_issues([issue])


def test_regime_text():
    more = {
        "stratified": ({"stratify_field": "y"}, " stratified by 'y'"), "group": ({"group_field": "g"}, " grouped by 'g'"),
        "temporal": ({"time_field": "t"}, " ordered by 't'"), "random": ({}, ""),
        "structure_aware": ({"identity": {"measure": "structure"}}, " using structure")
    }
    for protocol, (fields, text) in more.items():
        spec = {k: v for k, v in SPLIT.items() if k != "identity"} | {"protocol": protocol} | fields
        assert S.parse("split", spec).describe_regime() == f"{protocol} split{text}"
    assert S.parse("split", SPLIT).describe_regime() == "cluster_aware split using sequence_identity (threshold=0.3)"


def test_run_pack_registers_once(tmp_path):
    for kind, document in BASE.items():
        (tmp_path / f"{kind}.yaml").write_text(yaml.safe_dump(document))
    first = S.run_pack(tmp_path, tmp_path / "registry", notes="one")
    again = S.run_pack(tmp_path, tmp_path / "registry", notes="two")
    run = first["record"].run_id
    assert run == again["record"].run_id == S.compute_run_id({k: s.fingerprint() for k, s in first["specs"].items()})
    assert first["registry_paths"]["run"].name == f"{run}.json"
    assert all(p.exists() and p.stem == first["specs"][k].fingerprint() for k, p in first["registry_paths"]["specs"].items())
    assert Registry(tmp_path / "registry").load_run(run)["notes"] == "one"  # put if absent
    with pytest.raises(FileNotFoundError):
        Registry(tmp_path / "registry").load_run("no")


def test_strict_raises_only_on_errors():
    specs = parsed(dataset__labels=[])
    with pytest.raises(ValueError, match="CONSIST_TRAIN_SUPERVISED_NO_LABELS"):
        S.validate_specs(specs, strict=True)
    assert S.summarize(S.validate_specs(specs))["ERROR"] == 1
    assert {i.code for i in check_alone(specs["dataset"])} == {"DATASET_UNLABELED"}


def test_issue_order_and_format():
    issues = [S.Issue("INFO", "B", "m"), S.Issue("ERROR", "Z", "m", "p", "h"), S.Issue("INFO", "A", "m", "q"), S.Issue("INFO", "A", "m")]
    assert [(i.code, i.path) for i in S.sort_issues(issues)] == [("Z", "p"), ("A", None), ("A", "q"), ("B", None)]
    assert S.format_issues(issues[1:2]) == "[ERROR] Z @ p: m (hint: h)"


def test_artifacts(tmp_path):
    record = S.create_record(parsed(), salt="s")
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    (tmp_path / "a/m.json").write_text("1"), (tmp_path / "b/m.json").write_text("2")
    for d in "ab":
        record.add_artifact("metrics", str(tmp_path / d / "m.json"), format="json")
    reg = Registry(tmp_path / "r")
    targets = reg.put_artifacts(record, mode="copy")
    assert sorted(p.read_text() for p in targets.values()) == ["1", "2"]  # equal names don't collide
    with pytest.raises(ValueError):
        reg.put_artifact(record.run_id, record.artifacts[0], mode="move")
    with pytest.raises(FileNotFoundError):
        reg.put_artifact(record.run_id, {"kind": "x", "path": str(tmp_path / "none")}, mode="copy")
    graph = S.lineage(record)
    assert len(graph["nodes"]) == 8 and [e["relation"] for e in graph["edges"]] == ["uses"] * 5 + ["produces"] * 2
    a = record.artifacts[0]
    assert artifact_id(record.run_id, a) == "artifact:" + hashlib.sha256(f"{record.run_id}|metrics|{a['path']}|json|None".encode()).hexdigest()


def test_pack_issues_table(spark):
    from splitwarden.plans.audit import pack_issues, severity_counts

    rows = [
        ("good", *(json.dumps(d) for d in BASE.values())), ("bad", json.dumps({"name": 1}), None, None, None, None),
        ("part", json.dumps(pack(dataset__labels=[])["dataset"]), json.dumps(SPLIT), None, json.dumps(TRAIN), None)
    ]
    found = pack_issues(spark.createDataFrame(rows, "pack_id string, dataset string, split string, embedding string, train string, execution string"))
    got = {(r.pack_id, r.code) for r in found.collect()}
    assert ("bad", "SPEC_SHAPE") in got and ("part", "CONSIST_TRAIN_SUPERVISED_NO_LABELS") in got
    assert {c for p, c in got if p == "good"} == {"EMB_NO_DATASET_LINK", "TRAIN_NO_SPLIT_LINK", "TRAIN_NO_EMB_LINK"}
    assert {r.pack_id: r.n_error for r in severity_counts(found, ["pack_id"]).collect()}["part"] == 1
