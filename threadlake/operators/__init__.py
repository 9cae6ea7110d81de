from . import (
    catalog,
    companions,
    containment,
    designs,
    dml,
    embedding,
    evaluation,
    folders,
    images,
    joins,
    ordered,
    pooling,
    search,
)

__all__ = [
    "catalog", "companions", "containment", "designs", "dml", "embedding",
    "evaluation", "folders", "images", "joins", "ordered", "pooling", "search",
]
