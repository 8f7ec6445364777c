"""Every operator as a query on the shared test tables, with equivalent SQL.

A query takes the session and the folder of the tables and returns a DataFrame
over whole tables. Its SQL is written independently, for another engine.
"""

from podium.plans.queries import basics, files, games, offsets, quality, ranking, stored, trend
from podium.plans.queries.registry import REGISTRY, Query

__all__ = ["REGISTRY", "Query", "basics", "files", "games", "offsets", "quality", "ranking", "stored", "trend"]
