from foliant.sources.tables import TABLES, table

__all__ = ["TABLES", "table"]
