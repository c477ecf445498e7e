"""Incident analytics over append-only event streams, on Spark."""
