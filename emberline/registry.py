"""Every registered query of the core library and its SQL."""

from emberline.plans import feeds, grids, imagery, records, registries, runs, space
from emberline.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "feeds", "grids", "imagery", "records", "registries", "runs", "space"]
