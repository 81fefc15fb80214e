"""Cutting lineage through tables in the folder that the cluster shares."""

from ..operators.scratch import shared_dir, written  # noqa: F401
