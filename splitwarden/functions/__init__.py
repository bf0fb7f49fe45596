"""Column expressions shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def shuffle_key(id_: Column, seed) -> Column:
    """A seeded, engine-independent order: md5 of id:seed. The same rows get the same order on any partitioning."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", id_.cast("string"), seed.cast("string")))


def strip(text: Column) -> Column:
    """Without outer white space, Unicode spaces included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def finite(x: Column) -> Column:
    """NaN as null, so that aggregates skip it."""
    return F.when(~F.isnan(x), x)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def short_model_name(name: Column) -> Column:
    """The part after the last slash, with underscores for hyphens."""
    return F.translate(F.element_at(F.split(name, "/"), -1), "-", "_")


def split_id(dataset: Column, strategy: Column, seed: Column) -> Column:
    """<dataset>__<strategy>__seed_<n>"""
    return F.concat_ws("__", dataset, strategy, F.concat(F.lit("seed_"), seed.cast("string")))


def seed_id(strategy: Column, seed: Column) -> Column:
    """<strategy>_seed_<n>"""
    return F.concat(strategy, F.lit("_seed_"), seed.cast("string"))


def embedding_id(model: Column, pooling: Column, batch: Column, device: Column, precision: Column) -> Column:
    """embedding_<model>_<pooling>_last_bs<batch>_<device>_<precision>"""
    return F.concat_ws("_", F.lit("embedding"), short_model_name(model), pooling, F.lit("last"), F.concat(F.lit("bs"), batch.cast("string")), device, precision)


def run_stamp(moment: Column) -> Column:
    """20240131T235959Z of a timestamp in a session on UTC; stamps sort as their moments do."""
    return F.date_format(moment, "yyyyMMdd'T'HHmmss'Z'")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "ERROR", 0).when(severity == "WARNING", 1).when(severity == "INFO", 2).otherwise(9)


def unit_vector(v: Column) -> Column:
    """L2-normalised in double precision; a zero vector stays."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    # a lambda's variable, so that the norm is worked out once for each vector and not for each of its numbers
    return F.transform(F.array(norm), lambda n: F.when(n > 0, F.transform(d, lambda x: x / n)).otherwise(d))[0]


def seed_list(text: str, count: int = 0) -> list[int]:
    """'1-10' is a range with both ends, '1,2,5' a list, '7' with a count the numbers from 7 on."""
    if "," in text:
        return [int(p) for p in text.split(",") if p.strip()]
    if m := re.fullmatch(r"\s*(\d+)\s*-\s*(\d+)\s*", text):
        return list(range(int(m[1]), int(m[2]) + 1))
    first = int(text)
    return list(range(first, first + max(1, count)))


def natural_columns(columns: list[str], prefix: str = "p_", fallback: list[str] | None = None) -> list[str]:
    """Columns with the prefix by their number (by name if a suffix is no number); without any, the fallback."""
    found = [c for c in columns if c.startswith(prefix)]
    if not found:
        return list(fallback or [])
    suffix = {c: c[len(prefix) :] for c in found}
    return sorted(found, key=lambda c: int(suffix[c])) if all(s.isdigit() for s in suffix.values()) else sorted(found)
