"""Models on pyspark.ml: estimators and grids, selection on the validation part with refit, clustering, calibration, embeddings."""
