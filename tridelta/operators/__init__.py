"""DataFrame operators on cells, factor tables, the core and slice maps."""
