from veilframe.sources.tables import TABLES, load  # noqa: F401
