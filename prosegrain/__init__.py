"""Prose uniformity analytics on Spark: DataFrame -> DataFrame operators over a corpus of texts."""
