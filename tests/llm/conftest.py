from odd import data, edge, empty  # noqa: F401
