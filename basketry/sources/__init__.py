from basketry.sources.tables import TableSet, TABLE_NAMES  # noqa: F401
