"""Whole jobs: the games analyses, their runner, and the queries on the shared test tables."""
