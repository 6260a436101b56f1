"""Spark jobs that turn a table of web pages into typed tables."""
