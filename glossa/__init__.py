"""Localization-quality analytics on Spark."""
