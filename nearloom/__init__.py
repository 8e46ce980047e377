"""nearloom: nearest-neighbour search and retrieval evaluation as Spark DataFrame operators."""

from nearloom.params import CodeParams, GraphParams, SearchParams

__all__ = ["CodeParams", "GraphParams", "SearchParams"]
