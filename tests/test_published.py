"""Published results: rates worked out again from published counts."""

from __future__ import annotations

from podium.operators import compare_offsets, growth_and_share, rollup_text, top_k
from podium.plans import games

# Year, sex, entries, growth since the previous games, share of the year.
TREND = """
1956,F,891,,17.474%
1956,M,4208,,82.526%
1960,F,1422,59.596%,17.595%
1960,M,6660,58.270%,82.405%
1964,F,1336,-6.048%,17.437%
1964,M,6326,-5.015%,82.563%
1968,F,1767,32.260%,20.659%
1968,M,6786,7.272%,79.341%
1972,F,2179,23.316%,21.219%
1972,M,8090,19.216%,78.781%
1976,F,2164,-0.688%,25.101%
1976,M,6457,-20.185%,74.899%
1980,F,1755,-18.900%,24.409%
1980,M,5435,-15.828%,75.591%
1984,F,2442,39.145%,25.907%
1984,M,6984,28.500%,74.093%
1988,F,3535,44.758%,29.439%
1988,M,8473,21.320%,70.561%
1992,F,4114,16.379%,31.778%
1992,M,8832,4.237%,68.222%
1996,F,4998,21.488%,36.328%
1996,M,8760,-0.815%,63.672%
2000,F,5430,8.643%,39.302%
2000,M,8386,-4.269%,60.698%
2004,F,5545,2.118%,41.257%
2004,M,7895,-5.855%,58.743%
2008,F,5816,4.887%,42.768%
2008,M,7783,-1.419%,57.232%
2012,F,5815,-0.017%,45.029%
2012,M,7099,-8.788%,54.971%
2016,F,6223,7.016%,45.473%
2016,M,7462,5.113%,54.527%
"""

# Host year and country; medals at home, 4 and 8 years before,
# 4 and 8 years after; lead in percent of the medals at home.
HOSTS = """
1956,AUS,67,0,0,46,44,31.343283582089555
1960,ITA,88,47,0,51,33,42.04545454545455
1964,JPN,62,31,24,63,56,-1.6129032258064515
1968,MEX,9,1,1,1,2,77.77777777777779
1972,FRG,102,51,0,77,0,24.509803921568626
1976,CAN,23,11,10,0,85,-269.5652173913044
1980,URS,442,286,214,0,300,32.126696832579185
1984,USA,339,0,156,196,215,36.57817109144543
1988,KOR,77,41,0,49,66,14.285714285714285
1992,ESP,69,5,19,66,42,4.3478260869565215
1996,USA,248,215,196,241,262,-5.64516129032258
2000,AUS,183,132,57,157,149,14.207650273224044
2004,GRE,31,18,8,7,3,41.935483870967744
2008,CHN,184,94,79,125,113,32.065217391304344
2012,GBR,126,81,57,145,0,-15.079365079365079
2016,BRA,50,59,78,0,0,-56.00000000000001
"""

# The ten largest teams of one year, with a tie at the end.
TEN_LARGEST = "GER-478, URS-463, JPN-456, USA-455, AUS-391, HUN-319, GBR-300, ITA-256, KOR-240, POL-240"


def lines(text):
    return [line.split(",") for line in text.strip().splitlines()]


def test_growth_and_shares(spark):
    rows = lines(TREND)
    counts = spark.createDataFrame(
        [(int(y), sex, int(n)) for y, sex, n, _, _ in rows], "Year int, Sex string, n bigint"
    )
    for totals in ("join", "window"):
        trend = growth_and_share(counts, "Sex", "Year", totals=totals).orderBy("Year", "Sex").collect()
        got = [[str(r.Year), r.Sex, str(r.n), r.growth_text or "", r.share_text] for r in trend]
        assert got == rows
        assert sum(r.n for r in trend) == 171_068


def test_host_margins(spark):
    cells = {}
    for year, noc, *values in lines(HOSTS):
        for step, value in zip((0, -4, -8, 4, 8), values):
            if int(value):
                cells[int(year) + step, noc] = int(value)
    counts = spark.createDataFrame(
        [(y, noc, n) for (y, noc), n in cells.items()], "Year int, NOC string, n bigint"
    )
    hosts = {year: noc for year, noc in games.HOSTS.items() if year >= 1956}
    assert len(games.HOSTS) == 28 and len(hosts) == 16
    got = compare_offsets(counts, hosts, period="Year", group="NOC", offsets=(-4, -8, 4, 8))
    table = {
        r.Year: (r.NOC, r.n_host, r.n_other1, r.n_other2, r.n_other3, r.n_other4, r.margin_over_host_pct)
        for r in got.collect()
    }
    for year, noc, *values, margin in lines(HOSTS):
        assert table[int(year)] == (noc, *map(int, values), float(margin))


def test_change_over_the_best_other_games(spark):
    counts = spark.createDataFrame([(1976, "CAN", 23), (1984, "CAN", 85)], "Year int, NOC string, n bigint")
    row = compare_offsets(
        counts, {1976: "CAN"}, period="Year", group="NOC", offsets=(-4, -8, 4, 8)
    ).first()
    assert round(row.change_over_best_pct, 3) == -72.941


def test_tie_at_the_end_of_a_list(spark):
    counts = spark.createDataFrame(
        [(1964, *item.split("-")) for item in TEN_LARGEST.split(", ")], "Year int, NOC string, n string"
    ).selectExpr("Year", "NOC", "CAST(n AS bigint) AS n")
    best = top_k(counts, ["Year"], "n", ["NOC"], 10)
    assert rollup_text(best, ["Year"], ["rank"], ["NOC", "n"], "t").first().t == TEN_LARGEST
