"""Tables that cut lineage, in the folder that the cluster shares."""

from ..sources.scratch import BATCH, batches, drop, folder, keep, near, small

__all__ = ["BATCH", "batches", "drop", "folder", "keep", "near", "small"]
