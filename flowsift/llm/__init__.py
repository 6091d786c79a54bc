"""Operators for preparing training data, written for Spark."""
