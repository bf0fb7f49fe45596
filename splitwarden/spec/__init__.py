"""Declarative specifications, their rules, fingerprints, provenance, lineage and registry."""

from .api import create_record, load_specs, register_run, run_pack, validate_files, validate_specs
from .lineage import lineage
from .provenance import Record, compute_run_id
from .registry import Registry
from .rules import Issue, check_pack, format_issues, sort_issues, summarize
from .schema import KINDS, Spec, SpecError, parse

__all__ = [
    "KINDS", "Issue", "Record", "Registry", "Spec", "SpecError", "check_pack", "compute_run_id", "create_record", "format_issues", "lineage", "load_specs",
    "parse", "register_run", "run_pack", "sort_issues", "summarize", "validate_files", "validate_specs"
]
