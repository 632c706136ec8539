"""Attestra: an evidence-gated content-bank engine on Spark DataFrames."""
