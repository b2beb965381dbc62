from spanloom.plans import more  # noqa: F401  registers its queries
from spanloom.plans.queries import flagship, oracle_sql, queries

__all__ = ["flagship", "oracle_sql", "queries"]
