from . import files, progress_table, report, roots, tables

__all__ = ["files", "progress_table", "report", "roots", "tables"]
