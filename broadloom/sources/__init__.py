"""Readers and writers for feature tables, stage tables and text artefacts."""
