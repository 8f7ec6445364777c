"""podium: batch analytics for results tables, written on Spark DataFrames.

``functions`` build columns, ``operators`` turn DataFrames into DataFrames,
``sources`` read and write, ``plans`` put them together into whole jobs.
"""
