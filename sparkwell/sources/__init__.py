"""Readers of files and tables."""

from .repertoire import read_metadata, read_shards, read_unit, study_files

__all__ = ["read_metadata", "read_shards", "read_unit", "study_files"]
