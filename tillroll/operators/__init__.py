"""Dashboard and analysis tables, one function per result table, each ``(Model) -> DataFrame``."""
