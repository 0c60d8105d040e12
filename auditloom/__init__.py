"""Spark jobs that audit extracted evidence: tables in, tables out."""
