"""The games analyses and their job, from file to file."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.errors import AnalysisException

from podium.plans import games, job
from podium.sources import clear, read_csv_text, shared_dir, stage

HEADER = "ID,Name,Sex,Age,Height,Weight,Team,NOC,Games,Year,Season,City,Sport,Event,Medal"
# Small made-up results file: a team medal, a tie, missing values, out-of-scope rows.
ENTRIES = [
    '1,"Al ""Bob"", Jr.",M,24,181,80,Australia,AUS,1956 Summer,1956,Summer,Melbourne,Hockey,Hockey Men,Gold',
    "2,Cy,M,26,182,NA,Australia,AUS,1956 Summer,1956,Summer,Melbourne,Hockey,Hockey Men,Gold",
    "3,Di,F,21,NA,60,Australia,AUS,1956 Summer,1956,Summer,Melbourne,Diving,Platform,NA",
    "4,Ed,M,33,175,70,France,FRA,1956 Summer,1956,Summer,Melbourne,Diving,Platform,Silver",
    "1,Al,M,28,181,81,Australia,AUS,1960 Summer,1960,Summer,Roma,Hockey,Hockey Men,Bronze",
    "5,Flo,F,NA,NA,NA,Italy,ITA,1960 Summer,1960,Summer,Roma,Diving,Platform,Gold",
    "6,Gus,M,80,221,29,Italy,ITA,1960 Summer,1960,Summer,Roma,Fencing,Foil,Gold",
    "7,Hal,M,20,170,66,France,FRA,1960 Summer,1960,Summer,Roma,Fencing,Foil,NA",
    "8,Ida,F,22,170,66,France,FRA,1960 Winter,1960,Winter,Squaw Valley,Luge,Single,Gold",
    "9,Jo,F,22,170,66,France,FRA,1952 Summer,1952,Summer,Helsinki,Fencing,Foil,Gold",
]
# A quote that was not doubled: the record falls apart and its fields move to the right.
SHIFTED = r'10,"Kim \"Kit\", Jr.",F,22,170,66,France,FRA,1960 Summer,1960,Summer,Roma,Fencing,Foil,Gold'


@pytest.fixture
def path(tmp_path):
    file = tmp_path / "results.csv"
    file.write_text("\n".join([HEADER, *ENTRIES]) + "\n", encoding="UTF-8")
    return str(file)


@pytest.fixture
def scoped(spark, path):
    return games.scope(games.read_results(spark, path))


def found(frame):
    return {tuple(r) for r in frame.collect()}


def test_scope_and_missing_values(spark, path, scoped):
    everything = games.read_results(spark, path)
    assert (everything.count(), scoped.count()) == (10, 8)
    cy = everything.filter("Name = 'Cy'").first()
    assert (cy.Age, cy.Weight, cy.Medal) == (26.0, None, "Gold")
    assert everything.filter("""Name = 'Al "Bob", Jr.'""").first().Medal == "Gold"


def test_participation(scoped):
    assert found(games.participation(scoped)) == {
        (1956, "F", 1, None, None, 4, "25.000%"),
        (1956, "M", 3, None, None, 4, "75.000%"),
        (1960, "F", 1, 1, "0.000%", 4, "25.000%"),
        (1960, "M", 3, 3, "0.000%", 4, "75.000%"),
    }


def test_countries_and_sports(scoped):
    assert found(games.top_countries(scoped)) == {
        (1956, "AUS-2, FRA-1"), (1960, "ITA-2, AUS-1, FRA-0"),
    }
    assert found(games.top_countries(scoped, 1, count=games.entry_table)) == {(1956, "AUS-3"), (1960, "ITA-2")}
    assert found(games.dominant_sports(scoped)) == {
        ("AUS", "Hockey-3"), ("FRA", "Diving-1"), ("ITA", "Fencing-1"),
    }


def test_winner_profile(scoped):
    assert found(games.winner_profile(scoped)) == {
        ("Hockey", "20-25", "180-185", "80-90"),
        ("Diving", None, None, None),
        ("Fencing", None, None, None),
    }


def test_host_advantage(scoped):
    hosts = {1956: "AUS", 1960: "ITA"}
    got = {r.Year: r for r in games.host_advantage(scoped, hosts).collect()}
    assert got[1956][1:8] == ("AUS", 2, 0, 0, 1, 0, 50.0)
    assert got[1960][1:8] == ("ITA", 2, 0, 0, 0, 0, 100.0)
    assert got[1956].nothost1_in_range is False and got[1956].nothost3_in_range is True
    once = {r.Year: r for r in games.host_advantage(scoped, hosts, unit="event").collect()}
    assert (once[1956].Medals_host, once[1956].Medals_nothost3) == (1, 1)
    assert games.host_advantage(scoped).count() == 16
    with pytest.raises(ValueError):
        games.medal_table(scoped, ["NOC"], "country")


def test_host_of_every_entry(spark, path):
    hosts = games.with_host(games.read_results(spark, path))
    assert {(r.Year, r.Host_Country) for r in hosts.collect()} == {
        (1952, "FIN"), (1956, "AUS"), (1960, "ITA"),
    }


def test_unknown_environment():
    known = {"local": job.Environment("in", "out")}
    assert job.resolve("local", known).output == "out"
    with pytest.raises(ValueError, match="unknown environment 'moon'"):
        job.resolve("moon", known)


def test_environments_file(tmp_path):
    file = tmp_path / "environments.json"
    file.write_text(json.dumps({"store": {
        "input": "abfss://data@account.example/results.csv",
        "output": "abfss://data@account.example/out",
        "conf": {"spark.sql.shuffle.partitions": "2000"},
    }}))
    loaded = job.load_environments(str(file))
    assert loaded["store"].input.startswith("abfss://")
    assert loaded["store"].conf == {"spark.sql.shuffle.partitions": "2000"}


@pytest.mark.parametrize("stage, sep", [(False, ","), (True, ","), (True, ";")])
def test_job_writes_every_analysis(spark, path, tmp_path, stage, sep, capsys):
    with open(path, "a") as file:
        file.write(SHIFTED + "\n")
    if sep == ";":
        path = str(tmp_path / "cleaned.csv")
        lines = [line.replace('"Al ""Bob"", Jr."', "Al Bob").replace(",", ";").replace(";NA;", ";;") for line in [HEADER, *ENTRIES]]
        (tmp_path / "cleaned.csv").write_text("\n".join(lines) + "\n", encoding="UTF-8")
    place = job.Environment(path, str(tmp_path / "out"))
    written = job.run(spark, place, analyses=list(job.ANALYSES), stage=stage, preview=2, explain=not stage, sep=sep)
    assert set(written) == set(job.ANALYSES)

    def read(target):
        return read_csv_text(spark, target)

    assert read(written["gender_ratio"]).columns == [
        "Year", "Sex", "Participant_Count", "Prev_Year_Participant",
        "Growth_Rate", "Total_Participants", "Participation_Ratio",
    ]
    assert read(written["top10_countries"]).count() == 2
    assert read(written["host_country_medals"]).columns[:8] == [
        "Year", "Country", "Medals_host", "Medals_nothost1", "Medals_nothost2",
        "Medals_nothost3", "Medals_nothost4", "Medals_bigger%",
    ]
    # Checks, repairs and the enrichment see the table as it was read.
    assert read(written["imputed"]).filter("Age IS NULL OR Height IS NULL OR Weight IS NULL").count() == 0
    assert read(written["imputed"]).count() == 10
    assert read(written["missing_by_games"]).first()[:] == ("1956 Summer", "1", "1")
    assert read(written["format_check"]).first()[:] == ("Games", games.GAMES_FORMAT, "1")  # the winter games
    assert read(written["distinct_rows"]).first()[0] == "10"
    assert {tuple(r) for r in read(written["host_enrichment"]).groupBy("Host_Country").count().collect()} == {("AUS", 4), ("ITA", 5), ("FIN", 1)}
    assert read(written["column_catalog"]).count() == 15
    rejected = read(written["rejected_records"]).collect()
    assert [(r.record, r.reasons) for r in rejected] == ([] if sep == ";" else [(SHIFTED, "fields")])
    assert ("Physical Plan" in capsys.readouterr().out) is not stage


def test_job_keeps_old_results_on_request(spark, path, tmp_path):
    place = job.Environment(path, str(tmp_path / "out"))
    job.run(spark, place, analyses=["top10_countries"], fmt="parquet", mode="errorifexists")
    with pytest.raises(Exception, match="(?i)already exists"):
        job.run(spark, place, analyses=["top10_countries"], fmt="parquet", mode="errorifexists")


def test_a_refused_job_reads_and_writes_nothing(spark, path, tmp_path):
    """Also if only its last result is there, the first ones are not written, and the file is not read: a missing one makes no difference."""
    out = tmp_path / "out"
    job.run(spark, job.Environment(path, str(out)), analyses=["top10_countries"], fmt="parquet")
    before = sorted(os.listdir(out / "top10_countries"))
    for source in (path, str(tmp_path / "no-such-file.csv")):
        with pytest.raises(AnalysisException, match="(?i)already exists"):
            job.run(spark, job.Environment(source, str(out)), analyses=["gender_ratio", "null_profile", "top10_countries"], fmt="parquet", mode="errorifexists")
    assert os.listdir(out) == ["top10_countries"] and sorted(os.listdir(out / "top10_countries")) == before


def test_shared_counts_give_the_same_results(spark, scoped):
    """One scan and one shuffle serve the five analyses."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = games.shared(scoped).table._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "Python" not in plan
    hosts = {1956: "AUS", 1960: "ITA"}
    at_once = games.from_shared(games.shared(scoped).stored(stage), hosts)
    alone = {name: make(scoped) for name, make in job.ANALYSES.items() if name in job.DEFAULT_ANALYSES}
    alone["host_country_medals"] = games.host_advantage(scoped, hosts)
    assert set(at_once) == set(alone) == set(job.DEFAULT_ANALYSES)
    for name, frame in alone.items():
        assert at_once[name].schema.simpleString() == frame.schema.simpleString()
        assert found(at_once[name]) == found(frame), name


def test_job_counts_while_it_writes(spark, path, tmp_path):
    place, counts = job.Environment(path, str(tmp_path / "out")), {}
    written = job.run(spark, place, analyses=["imputed", "complete_rows", "null_profile"], counts=counts)
    assert (counts["imputed"]["rows"], counts["complete_rows"]["rows"]) == (10, 7)
    assert counts["imputed"]["nulls"]["Age"] == 0 and counts["imputed"]["nulls"]["Medal"] == 0
    assert counts["null_profile"]["rows"] == read_csv_text(spark, written["null_profile"]).count() == 15


def test_job_leaves_no_copies(spark, path, tmp_path):
    import os

    folder = shared_dir(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    job.run(spark, job.Environment(path, str(tmp_path / "out")))
    assert {f for f in os.listdir(folder) if f.startswith("job-")} - before == set()
    with pytest.raises(ValueError):
        clear(spark, str(tmp_path))
