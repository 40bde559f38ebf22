"""Latent-state analysis of time series on Spark, and training-data operators."""
