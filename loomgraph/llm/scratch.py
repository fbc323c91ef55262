"""Tables that cut lineage, kept in the folder that the cluster shares: those of the engine."""

from loomgraph.sources.tables import cut, drop, folder, new_path

__all__ = ["cut", "drop", "folder", "new_path"]
