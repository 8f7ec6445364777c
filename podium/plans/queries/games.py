"""The games analyses on a results table that Spark derives from the shared tables.

One entry per line item: the customer is the athlete, the part's brand the
sport, the order's priority the medal.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.operators.sets import union_all
from podium.plans import games, job
from podium.plans.queries.ranking import mode_sql
from podium.plans.queries.registry import REGISTRY, query, table
from podium.sources.scratch import scratch_path, stage
from podium.sources.sinks import write_csv

HOSTS = {
    1956: "NATION_1",
    1960: "NATION_5",
    1964: "NATION_9",
    1972: "NATION_1",
    1976: "NATION_20",
}


def results(spark: SparkSession, sf_dir: str, city: bool = True) -> DataFrame:
    """A table with the columns of :data:`games.RESULTS_SCHEMA`, some values missing.

    ``City`` takes a join of its own, which analyses that do not use it leave out.
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
    )
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment"
    )
    nation = table(spark, sf_dir, "nation")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    if city:
        region = table(spark, sf_dir, "region")
        placed = placed.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    entries = (
        table(spark, sf_dir, "lineitem")
        .join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )
    year = (F.lit(1952) + (F.year("o_orderdate") - F.lit(1995)) * F.lit(4)).cast("int")
    season = F.when(F.col("l_linestatus") == "O", F.lit("Summer")).otherwise(F.lit("Winter"))
    medal = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("Gold"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("Silver"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("Bronze"))
        .otherwise(F.lit("NA"))
    )

    def unless(missing: Column, value: Column) -> Column:
        return F.when(~missing, value.cast("double"))

    return entries.select(
        F.col("o_custkey").cast("int").alias("ID"),
        F.col("c_name").alias("Name"),
        F.when(F.col("o_orderstatus") == "F", F.lit("F")).otherwise(F.lit("M")).alias("Sex"),
        unless(F.col("l_discount") == 0, F.col("l_quantity") + F.lit(9)).alias("Age"),
        unless(F.col("l_tax") == 0, F.col("p_size") + F.lit(140)).alias("Height"),
        unless(F.col("l_linenumber") == 1, F.col("p_partkey") % 120 + 35).alias("Weight"),
        F.col("c_mktsegment").alias("Team"),
        F.col("n_name").alias("NOC"),
        F.concat_ws(" ", year, season).alias("Games"),
        year.alias("Year"),
        season.alias("Season"),
        *([F.col("r_name").alias("City")] if city else []),
        F.col("p_brand").alias("Sport"),
        F.col("p_type").alias("Event"),
        medal.alias("Medal"),
    )


ENTRIES_SQL = """
WITH entries AS (
  SELECT CAST(1952 + (year(o_orderdate) - 1995) * 4 AS INTEGER) AS "Year",
         CASE WHEN l_linestatus = 'O' THEN 'Summer' ELSE 'Winter' END AS "Season",
         CAST(o_custkey AS INTEGER) AS "ID",
         CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'M' END AS "Sex",
         CASE WHEN l_discount <> 0 THEN l_quantity + 9 END AS "Age",
         CASE WHEN l_tax <> 0 THEN CAST(p_size + 140 AS DOUBLE) END AS "Height",
         CASE WHEN l_linenumber <> 1 THEN CAST(p_partkey % 120 + 35 AS DOUBLE) END AS "Weight",
         n_name AS "NOC", p_brand AS "Sport", p_type AS "Event",
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Gold' WHEN '2-HIGH' THEN 'Silver'
                              WHEN '3-MEDIUM' THEN 'Bronze' ELSE 'NA' END AS "Medal"
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey
), scoped AS (
  SELECT * FROM entries WHERE "Season" = 'Summer' AND "Year" >= 1956
)
"""


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return games.scope(results(spark, sf_dir, city=False))


@query(ENTRIES_SQL + """
, counts AS (
  SELECT "Sex", "Year", count("ID") AS n FROM scoped GROUP BY 1, 2
), compared AS (
  SELECT "Sex", "Year", n, lag(n) OVER (PARTITION BY "Sex" ORDER BY "Year") AS prev,
         CAST(sum(n) OVER (PARTITION BY "Year") AS BIGINT) AS total
  FROM counts
)
SELECT "Year", "Sex", n AS "Participant_Count", prev AS "Prev_Year_Participant",
       CAST(CAST((n - prev) / prev * 100 AS DECIMAL(10, 3)) AS VARCHAR) || '%' AS "Growth_Rate",
       total AS "Total_Participants",
       CAST(CAST(n / total * 100 AS DECIMAL(10, 3)) AS VARCHAR) || '%' AS "Participation_Ratio"
FROM compared
""")
def games_participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return games.participation(_scoped(spark, sf_dir))


def _top_sql(counted: str) -> str:
    return ENTRIES_SQL + f"""
, counts AS (
  SELECT "Year", "NOC", count({counted}) AS n FROM scoped GROUP BY 1, 2
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY "Year" ORDER BY n DESC, "NOC") AS place FROM counts
)
SELECT "Year", string_agg("NOC" || '-' || CAST(n AS VARCHAR), ', ' ORDER BY place) AS "Top10Countries"
FROM ranked WHERE place <= 10 GROUP BY "Year"
"""


@query(_top_sql("""CASE WHEN "Medal" <> 'NA' THEN 1 END"""))
def games_top_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return games.top_countries(_scoped(spark, sf_dir))


@query(_top_sql("*"))
def games_top_countries_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts every entry, medal or not."""
    return games.top_countries(_scoped(spark, sf_dir), count=games.entry_table)


@query(ENTRIES_SQL + """
, counts AS (
  SELECT "Sport", "NOC", count(CASE WHEN "Medal" <> 'NA' THEN 1 END) AS n FROM scoped GROUP BY 1, 2
), leaders AS (
  SELECT * FROM counts
  QUALIFY row_number() OVER (PARTITION BY "Sport" ORDER BY n DESC, "NOC") = 1
)
SELECT "NOC", string_agg("Sport" || '-' || CAST(n AS VARCHAR), ', ' ORDER BY "Sport") AS "DominantSports"
FROM leaders GROUP BY "NOC"
""")
def games_dominant_sports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return games.dominant_sports(_scoped(spark, sf_dir))


PROFILE_SCALES = {
    "Age_Bin": ('"Age"', 10, 80, 5),
    "Height_Bin": ('"Height"', 120, 220, 5),
    "Weight_Bin": ('"Weight"', 30, 150, 10),
}


@query(
    ENTRIES_SQL
    + """, gold AS (SELECT * FROM scoped WHERE "Medal" = 'Gold')"""
    + mode_sql('"Sport"', "gold", PROFILE_SCALES, null_last=True)
)
def games_winner_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return games.winner_profile(_scoped(spark, sf_dir))


OTHERS = {"Medals_nothost1": -4, "Medals_nothost2": -8, "Medals_nothost3": 4, "Medals_nothost4": 8}


def _host_sql(item: str) -> str:
    hosts = ", ".join(f"({year}, '{noc}')" for year, noc in HOSTS.items())
    cells = ", ".join(
        f"""count({item.format(f'"Medal" <> \'NA\' AND f."Year" = h.y + ({step})')}) AS "{name}" """
        for name, step in {"Medals_host": 0, **OTHERS}.items()
    )
    ranges = ", ".join(
        f"y + ({step}) BETWEEN first_year AND last_year AS {name.split('_')[1]}_in_range"
        for name, step in OTHERS.items()
    )
    return ENTRIES_SQL + f"""
, hosts(y, noc) AS (VALUES {hosts}),
ends AS (SELECT min("Year") AS first_year, max("Year") AS last_year FROM scoped),
compared AS (
  SELECT h.y, h.noc, {cells} FROM hosts h LEFT JOIN scoped f ON f."NOC" = h.noc GROUP BY h.y, h.noc
), best AS (
  SELECT *, greatest({', '.join(f'"{name}"' for name in OTHERS)}) AS best_other FROM compared
)
SELECT CAST(y AS INTEGER) AS "Year", noc AS "Country", "Medals_host",
       {', '.join(f'"{name}"' for name in OTHERS)}, {ranges},
       ("Medals_host" - best_other) / nullif("Medals_host", 0) * 100 AS "Medals_bigger%",
       ("Medals_host" - best_other) / nullif(best_other, 0) * 100 AS change_over_best_pct
FROM best, ends
"""


@query(_host_sql('CASE WHEN {} THEN "Event" END'))
def games_host_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return games.host_advantage(_scoped(spark, sf_dir), HOSTS)


@query(_host_sql("""DISTINCT CASE WHEN {} THEN "Event" || '/' || "Medal" END"""))
def games_host_advantage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A team's medal counts once."""
    return games.host_advantage(_scoped(spark, sf_dir), HOSTS, unit="event")


def _lines(analysis: str, label: list[str], values: list[str]) -> str:
    text = lambda columns: "concat_ws('|', " + ", ".join(f"""coalesce(CAST("{c}" AS VARCHAR), '')""" for c in columns) + ")"
    return f"SELECT '{analysis}' AS analysis, {text(label)} AS label, {text(values)} AS result FROM ({{}})"


AT_ONCE = {
    "gender_ratio": ("games_participation", ["Year", "Sex"], ["Participant_Count", "Prev_Year_Participant", "Growth_Rate", "Total_Participants", "Participation_Ratio"]),
    "top10_countries": ("games_top_countries", ["Year"], ["Top10Countries"]),
    "dominant_sports": ("games_dominant_sports", ["NOC"], ["DominantSports"]),
    "height_weight_age": ("games_winner_profile", ["Sport"], list(PROFILE_SCALES)),
    "host_country_medals": ("games_host_advantage", ["Year", "Country"], ["Medals_host", *OTHERS, *[f"{o.split('_')[1]}_in_range" for o in OTHERS]]),
}


@query(" UNION ALL ".join(_lines(a, label, values).format(REGISTRY[name].sql) for a, (name, label, values) in AT_ONCE.items()))
def analyses_at_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five analyses from one scan and one shuffle of the results."""
    counts = games.shared(_scoped(spark, sf_dir)).stored(stage)
    return _as_lines(games.from_shared(counts, HOSTS), list(AT_ONCE))


def _as_lines(found: Mapping[str, DataFrame], analyses: list[str]) -> DataFrame:
    def lines(analysis: str) -> DataFrame:
        _, label, values = AT_ONCE[analysis]
        text = lambda columns: F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns])
        return found[analysis].select(F.lit(analysis).alias("analysis"), text(label).alias("label"), text(values).alias("result"))

    return union_all([lines(a) for a in analyses])


BY_JOB = ["gender_ratio", "top10_countries", "dominant_sports", "height_weight_age"]


@query(
    " UNION ALL ".join(_lines(a, *AT_ONCE[a][1:]).format(REGISTRY[AT_ONCE[a][0]].sql) for a in BY_JOB)
    + " UNION ALL SELECT 'rejected_records', '', '0' UNION ALL SELECT 'second run', 'refused', 'old result kept'"
)
def job_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job from a CSV file to parquet results; a second run that must not overwrite fails and changes nothing."""
    source, target = scratch_path(spark, "results-csv"), scratch_path(spark, "results-out")
    write_csv(results(spark, sf_dir), source, null_value="NA")
    place = job.Environment(source, target)
    written = job.run(spark, place, analyses=[*BY_JOB, job.REJECTED], fmt="parquet")
    try:
        job.run(spark, place, analyses=BY_JOB[:1], fmt="parquet", mode="errorifexists")
        second = "overwritten"
    except AnalysisException:
        second = "refused"
    found = {a: spark.read.parquet(path) for a, path in written.items()}
    more = [
        found.pop(job.REJECTED).agg(F.count("*").cast("string").alias("result")).select(F.lit(job.REJECTED).alias("analysis"), F.lit("").alias("label"), "result"),
        found["gender_ratio"].agg(F.when(F.count("*") > 0, F.lit("old result kept")).alias("result")).select(F.lit("second run").alias("analysis"), F.lit(second).alias("label"), "result"),
    ]
    return union_all([_as_lines(found, BY_JOB), *more])
