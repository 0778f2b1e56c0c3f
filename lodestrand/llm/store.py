"""Intermediate tables of the operators: those of the whole library."""

from ..sources.tables import SETTING, SMALL_BATCHES, clean_up, fresh_path, materialise, materialise_joined, partitions, scratch, shared_dir

__all__ = ["SETTING", "SMALL_BATCHES", "clean_up", "fresh_path", "materialise", "materialise_joined", "partitions", "scratch", "shared_dir"]
