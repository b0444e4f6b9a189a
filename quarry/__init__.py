"""Quarry: repository-evidence analytics as Spark jobs (tables in, tables out)."""
