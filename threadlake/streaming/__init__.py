from . import events, ingest, progress

__all__ = ["events", "ingest", "progress"]
