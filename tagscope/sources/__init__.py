"""Scans and sources: history tables, views over the test tables, JDBC, logs."""
