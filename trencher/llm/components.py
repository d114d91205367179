"""Connected components whose rounds are stored as this package stores its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from trencher.llm.shared import stored
from trencher.operators import components


def roots(links: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``links(a, b)``, both longs: the least node reachable."""
    return components.roots(links, stored)
