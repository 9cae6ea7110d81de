from . import paths, scalars, vectors

__all__ = ["paths", "scalars", "vectors"]
