"""Readers: strict CSV, coverage and feature documents, query results, linked data, lookup files, vocabularies."""
