"""Embedding providers: name -> callable(df, sequence column, spec) that adds ``embedding``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kmer(df: DataFrame, sequence: str, spec=None, k: int = 3, dims: int = 256) -> DataFrame:
    """Hashed k-mer counts, normalised: needs no model, and is the same everywhere."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(sequence) - k + 1, F.lit(1))), lambda i: F.substring(F.col(sequence), i, F.lit(k)))
    counted = HashingTF(inputCol="__grams", outputCol="__counts", numFeatures=dims).transform(
        df.withColumn("__grams", F.coalesce(grams, F.array().cast("array<string>")))
    )
    unit = Normalizer(inputCol="__counts", outputCol="__unit", p=2.0).transform(counted)
    return unit.withColumn("embedding", vector_to_array("__unit", "float32")).drop("__grams", "__counts", "__unit")


PROVIDERS: dict[str, Callable] = {"kmer": kmer}


def pool(
    tokens: DataFrame, id_col: str, position: str, vector: str, method: str = "mean", weight: str | None = None, max_length: int | None = None
) -> DataFrame:
    """(id, embedding) of a table with one row for each token: mean or sum of its vectors, the first one (cls), or their mean by the
    ``weight`` column (attention). Tokens from position ``max_length`` on are cut off. Sums are partial in each task."""
    rows = tokens if max_length is None else tokens.where(F.col(position) < max_length)
    rows = rows.withColumn("__v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    if method == "cls":
        found = F.min_by("__v", position)
    elif method in ("mean", "sum"):
        found = {"mean": Summarizer.mean, "sum": Summarizer.sum}[method](F.col("__v"))
    elif method == "attention":
        if weight is None:
            raise ValueError("attention pooling needs the column of the weights")
        found = Summarizer.mean(F.col("__v"), F.col(weight))
    else:
        raise NotImplementedError(f"pooling {method}; there are mean, cls, sum and attention")
    return rows.groupBy(id_col).agg(found.alias("__pooled")).select(id_col, vector_to_array("__pooled", "float32").alias("embedding"))


def select_layer(embedder, layer="last") -> dict:
    """Sets the layer of a provider's embedder through the first attribute it has for that, and says which; else its own default stays."""
    value = -1 if layer == "last" else int(layer)
    for name in ("layer", "layer_idx", "layer_index", "layers"):
        if hasattr(embedder, name):
            setattr(embedder, name, value)
            return {"layer": layer, "attribute": name, "value": value}
    return {"layer": "default", "attribute": None, "value": None}


def embed(df: DataFrame, sequence: str, provider: str = "kmer", spec=None, **options) -> DataFrame:
    if provider not in PROVIDERS:
        raise NotImplementedError(f"no provider {provider}; register a callable in PROVIDERS, there are {', '.join(PROVIDERS)}")
    return PROVIDERS[provider](df, sequence, spec, **options)


def from_wide(df: DataFrame, columns: list[str]) -> DataFrame:
    """One column for each dimension, as ``embedding``."""
    return df.withColumn("embedding", F.array(*[F.col(c).cast("float") for c in columns])).drop(*columns)


def feature_matrix(df: DataFrame, columns: list[str], sequence: str = "sequence", missing: str = "<missing_seq>") -> DataFrame:
    """from_wide, with a sequence column in any case: ``missing`` where there is none."""
    out = from_wide(df, columns)
    text = F.col(sequence).cast("string") if sequence in df.columns else F.lit(None).cast("string")
    return out.withColumn(sequence, F.coalesce(text, F.lit(missing)))
