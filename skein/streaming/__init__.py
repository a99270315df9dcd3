"""Incremental reading of graph files."""
