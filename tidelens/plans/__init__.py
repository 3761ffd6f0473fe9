"""Registered queries: operators applied to the given tables."""


def registered() -> tuple[dict, dict]:
    """(queries, SQL) of all modules of this package."""
    from tidelens.plans import catalog, catalog_more

    assert catalog_more.query is catalog.query  # its queries are in the same tables

    return dict(catalog.QUERIES), dict(catalog.SQL)
