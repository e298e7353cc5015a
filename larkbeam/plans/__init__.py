"""Named queries over the tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from larkbeam.plans.registry import QUERIES, Query


def all_queries() -> dict[str, Query]:
    from larkbeam.plans import (  # noqa: F401
        aggregates,
        joins,
        python_functions,
        scalars,
        sets,
        sources,
        star,
        streams,
        timeseries,
        windows,
    )

    return dict(QUERIES)
