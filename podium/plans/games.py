"""The analyses of a games-results table: one row per athlete and event entered.

Every function takes the table and returns a result; column names are those of
the published result files. The table comes from :func:`read_results`, or from
anywhere else with the columns a function uses.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.functions.bands import Bands
from podium.functions.predicates import SENTINEL, in_scope, is_present
from podium.operators.offsets import compare_offsets, enrich
from podium.operators.quality import format_report
from podium.operators.ranking import leaders, modal_bands, modes_of_counts, rollup_text, top_k
from podium.operators.shared import SharedCounts, shared_counts
from podium.operators.tally import tally
from podium.operators.trend import growth_and_share
from podium.sources.readers import read_csv_typed

# Columns of the results file.
RESULTS_SCHEMA = (
    "ID int, Name string, Sex string, Age double, Height double, Weight double, "
    "Team string, NOC string, Games string, Year int, Season string, City string, "
    "Sport string, Event string, Medal string"
)

# Host country of every summer games, by year.
HOSTS = {
    1896: "GRE",
    1900: "FRA",
    1904: "USA",
    1908: "GBR",
    1912: "SWE",
    1920: "BEL",
    1924: "FRA",
    1928: "NED",
    1932: "USA",
    1936: "GER",
    1948: "GBR",
    1952: "FIN",
    1956: "AUS",
    1960: "ITA",
    1964: "JPN",
    1968: "MEX",
    1972: "FRG",
    1976: "CAN",
    1980: "URS",
    1984: "USA",
    1988: "KOR",
    1992: "ESP",
    1996: "USA",
    2000: "AUS",
    2004: "GRE",
    2008: "CHN",
    2012: "GBR",
    2016: "BRA",
}

# Scope of the analyses, format of the games' names, ends and widths of the bands.
SCOPE_TEXT = "Summer"
SCOPE_FIRST_YEAR = 1956
GAMES_FORMAT = r"^\d{4} Summer$"

AGE_BANDS = Bands.even(10, 80, 5)
HEIGHT_BANDS = Bands.even(120, 220, 5)
WEIGHT_BANDS = Bands.even(30, 150, 10)
PROFILE = {
    "Age_Bin": ("Age", AGE_BANDS),
    "Height_Bin": ("Height", HEIGHT_BANDS),
    "Weight_Bin": ("Weight", WEIGHT_BANDS),
}
GOLD = "Gold"


def read_results(
    spark: SparkSession, path: str, *, sep: str = ",", null_value: str | None = None
) -> DataFrame:
    """The results file. A missing medal stays the text ``NA``, unless ``null_value`` names it; missing numbers are NULL."""
    return read_csv_typed(spark, path, RESULTS_SCHEMA, sep=sep, null_value=null_value)


def scope(
    results: DataFrame, text: str | None = None, first_year: int = SCOPE_FIRST_YEAR, *, season: str = SCOPE_TEXT
) -> DataFrame:
    """Entries of the chosen season from the chosen year on.

    The season is a column of its own, so its test reaches the scan. ``text``
    looks for a part of ``Games`` instead, for tables where only that is right.
    """
    if text is not None:
        return results.filter(in_scope("Games", text, "Year", first_year))
    return results.filter((F.col("Season") == season) & (F.col("Year") >= first_year))


def participation(results: DataFrame) -> DataFrame:
    """Entries by sex and year, growth since the previous games and share of the year."""
    return participation_of(tally(results, ["Sex", "Year"], of="ID", name="Participant_Count"))


def participation_of(counts: DataFrame) -> DataFrame:
    """:func:`participation` from counts: ``Sex, Year, Participant_Count``."""
    trend = growth_and_share(counts, "Sex", "Year", "Participant_Count")
    return trend.select(
        "Year",
        "Sex",
        "Participant_Count",
        F.col("prev_Participant_Count").alias("Prev_Year_Participant"),
        F.col("growth_text").alias("Growth_Rate"),
        F.col("total_Participant_Count").alias("Total_Participants"),
        F.col("share_text").alias("Participation_Ratio"),
    )


def medal_table(results: DataFrame, by: list[str], unit: str = "athlete") -> DataFrame:
    """Medals per group, 0 for groups without any.

    ``unit="athlete"`` counts every member of a winning team, as the published
    results do; ``unit="event"`` counts a team once.
    """
    if unit not in ("athlete", "event"):
        raise ValueError("unit must be 'athlete' or 'event'")
    once = ["Event", "Medal"] if unit == "event" else None
    return tally(
        results, by, of="Event", where=is_present("Medal", SENTINEL), distinct=once, name="MedalCount"
    )


def entry_table(results: DataFrame, by: list[str]) -> DataFrame:
    """Entries per group under the same name; the published country lists count these."""
    return tally(results, by, name="MedalCount")


def top_countries(results: DataFrame | SharedCounts, k: int = 10, *, count=medal_table) -> DataFrame:
    """The ``k`` best countries of each games as one text per year."""
    best = top_k(count(results, ["Year", "NOC"]), ["Year"], "MedalCount", ["NOC"], k)
    return rollup_text(best, ["Year"], ["rank"], ["NOC", "MedalCount"], f"Top{k}Countries")


def dominant_sports(results: DataFrame | SharedCounts, *, count=medal_table) -> DataFrame:
    """The sports each country leads, as one text per leading country."""
    best = leaders(count(results, ["NOC", "Sport"]), ["Sport"], "MedalCount", ["NOC"])
    return rollup_text(best, ["NOC"], ["Sport"], ["Sport", "MedalCount"], "DominantSports")


def winner_profile(results: DataFrame, *, null_competes: bool = False) -> DataFrame:
    """The age, height and weight band most gold medallists of each sport were in."""
    gold = results.filter(F.col("Medal") == GOLD)
    bands = {name: (F.col(measure), scale) for name, (measure, scale) in PROFILE.items()}
    return modal_bands(gold, "Sport", bands, null_competes=null_competes)


def host_advantage(
    results: DataFrame,
    hosts: Mapping[int, str] | None = None,
    *,
    years_between: int = 4,
    unit: str = "athlete",
) -> DataFrame:
    """:func:`host_advantage_of` the medals by year and country."""
    return host_advantage_of(medal_table(results, ["Year", "NOC"], unit), hosts, years_between=years_between)


def host_advantage_of(
    medals: DataFrame, hosts: Mapping[int, str] | None = None, *, years_between: int = 4
) -> DataFrame:
    """Medals of each host at home and at the two games before and after.

    ``Medals_bigger%`` is the lead over the best other games in percent of the
    host count; ``change_over_best_pct`` has the best other games as its base.
    """
    hosts = hosts or {year: noc for year, noc in HOSTS.items() if year >= SCOPE_FIRST_YEAR}
    step = years_between
    compared = compare_offsets(
        medals,
        hosts,
        period="Year",
        group="NOC",
        count="MedalCount",
        offsets=(-step, -2 * step, step, 2 * step),
    )
    others = range(1, 5)
    return compared.select(
        "Year",
        F.col("NOC").alias("Country"),
        F.col("MedalCount_host").alias("Medals_host"),
        *[F.col(f"MedalCount_other{i}").alias(f"Medals_nothost{i}") for i in others],
        F.col("margin_over_host_pct").alias("Medals_bigger%"),
        "change_over_best_pct",
        *[F.col(f"other{i}_in_range").alias(f"nothost{i}_in_range") for i in others],
    )


def shared(results: DataFrame) -> SharedCounts:
    """All that the five analyses count, from one scan and one shuffle of the table."""
    columns = [
        *[F.col(c) for c in ("Sex", "Year", "NOC", "Sport")],
        *[scale.index(measure).alias(name) for name, (measure, scale) in PROFILE.items()],
    ]
    medal = is_present("Medal", SENTINEL) & F.col("Event").isNotNull()
    flags = {"_id": F.col("ID").isNotNull(), "_medal": F.coalesce(medal, F.lit(False)), "_gold": F.col("Medal").eqNullSafe(GOLD)}
    narrow = results.select(*columns, *[flag.alias(name) for name, flag in flags.items()])
    sets = [["Sex", "Year"], ["Year", "NOC"], ["NOC", "Sport"], *[["Sport", name] for name in PROFILE]]
    measures = {"Participant_Count": "_id", "MedalCount": "_medal", "GoldCount": "_gold"}
    return shared_counts(narrow, sets, {n: F.count_if(F.col(c)) for n, c in measures.items()})


def from_shared(counts: SharedCounts, hosts: Mapping[int, str] | None = None) -> dict[str, DataFrame]:
    """The five analyses, none of which reads the results again."""

    def medals(shared: SharedCounts, by: list[str]) -> DataFrame:
        return shared.counts(by, "MedalCount")

    gold = counts.stacked("Sport", list(PROFILE), "GoldCount").filter("_n > 0")
    return {
        "gender_ratio": participation_of(counts.counts(["Sex", "Year"], "Participant_Count")).orderBy("Year", "Sex"),
        "top10_countries": top_countries(counts, count=medals),
        "dominant_sports": dominant_sports(counts, count=medals),
        "height_weight_age": modes_of_counts(gold, "Sport", {name: scale for name, (_, scale) in PROFILE.items()}),
        "host_country_medals": host_advantage_of(medals(counts, ["Year", "NOC"]), hosts),
    }


def format_check(results: DataFrame) -> DataFrame:
    """How many entries have a ``Games`` text of another form; NULL counts too."""
    return format_report(results, {"Games": GAMES_FORMAT}, include_null=True)


def with_host(results: DataFrame, hosts: Mapping[int, str] | None = None) -> DataFrame:
    """Every entry with the country that hosted its year, NULL where none did."""
    return enrich(results, hosts or HOSTS, "Year", "Host_Country")
