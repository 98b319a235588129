"""All queries over the driver tables, by name, with their SQL, and the flagship."""

from __future__ import annotations

from . import base, q_catalog, q_functions, q_volume  # noqa: F401
from .q_volume import flagship  # noqa: F401


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
