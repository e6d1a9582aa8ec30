"""Spark-first analytics engine for investment-research workloads."""
