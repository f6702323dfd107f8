"""Collaboration analytics as Spark jobs: admission, sessions, inventories, operation logs, versions."""
