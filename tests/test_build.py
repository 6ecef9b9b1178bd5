"""Raw files to tables to answers."""

import pytest

from civicscope.operators.relations import latest
from civicscope.plans.answers import Answers
from civicscope.plans import profiles
from civicscope.plans.build import CO_LOCATED, StoredTables, bucketed_parts, build, open_answers, partition_periods
from civicscope.plans.contracts import CONTRACTS, check_contract
from civicscope.plans.tables import Tables
from civicscope.sources import files

REGISTER = """BUSINESS ACCT#,DBA NAME,ADDRESS,ZIP,NAICS,ACTIVITY DESC,START DT,CREATION DT,EXP DT
1,Bar One,1 Main,92101,722410,bar,1/5/2019,1/5/2019,
2,Bar Two,2 Main,92101-1111,722410,bar,1/5/2020,1/5/2020,
3,Cafe,3 Main,92102,722515,cafe,6/1/2020,6/1/2020,
4,Gym,4 Main,92102,999999,yoga studio,6/1/2020,6/1/2020,12/31/2019
"""
CENSUS = """NAME,B01003_001E,B01002_001E,B19013_001E,B25077_001E,B25064_001E,B15003_001E,B15003_022E,B15003_023E,B15003_024E,B15003_025E,zip code tabulation area
a,1000,30.5,50000,400000,1500,800,100,50,10,5,92101
b,2000,40.5,-666666666,500000,1700,900,100,50,10,5,92102
"""
GAZETTEER = "GEOID\tALAND\tAWATER\tALAND_SQMI\tAWATER_SQMI\tINTPTLAT\tINTPTLONG   \n92101\t1\t1\t1\t1\t32.71\t-117.16  \n92102\t1\t1\t1\t1\t32.75\t-117.12  \n99999\t1\t1\t1\t1\t40\t-70\n"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    inputs = {
        "register.csv": REGISTER,
        "census.csv": CENSUS,
        "gazetteer.txt": GAZETTEER,
        "names.csv": "zip_code,neighborhood\n92101,Downtown\n92102,Golden Hill\n",
        "areas.csv": "zip_code,area\n92101,Centre\n",
    }
    for name, body in inputs.items():
        (root / name).write_text(body)
    permits = spark.createDataFrame(
        [("92101", 2019, 5, 10.0), ("92101", 2020, 10, 20.0), ("92102", 2020, 2, 1.0)],
        "zip_code string, year int, permit_count bigint, total_valuation double",
    )
    permits.write.parquet(str(root / "permits"))
    config = {
        "register": [str(root / "register.csv")],
        "census": str(root / "census.csv"),
        "gazetteer": str(root / "gazetteer.txt"),
        "names": str(root / "names.csv"),
        "areas": str(root / "areas.csv"),
        "as_of": "2020-12-31",
        "previous_year": 2019,
        "current_year": 2020,
        "tables": {"civic_permits": str(root / "permits"), "civic_crime": str(root / "absent")},
    }
    target = str(root / "tables")
    return build(spark, config, target), target, config


def test_all_possible_tables_are_built(built):
    tables, _, _ = built
    assert {"businesses", "neighborhood_profile", "momentum_scores", "zip_centroids", "area_profile"} <= set(tables)
    assert tables["zip_centroids"].count() == 2


def test_a_stored_profile_is_one_filtered_scan(spark, built):
    _, target, config = built
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("profile", "profile")
    row = open_answers(spark, target, config["tables"]).profile("92101")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = row._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "EqualTo(zip_code,92101)" in plan
    assert len(jobs.getJobIdsForGroup("profile")) <= 3  # schemas of the files only
    assert row.first()["zip_code"] == "92101"


def test_answers_over_built_tables(spark, built):
    _, target, config = built
    answers = open_answers(spark, target, config["tables"])
    row = answers.rankings("businesses_per_1k").orderBy("rank").first()
    assert (row["zip_code"], row["sort_value"], row["neighborhood"]) == ("92101", 2.0, "Downtown")
    found = answers.nearby_competitors("drinking places", "92102").collect()
    assert [r["zip_code"] for r in found] == ["92101"]
    trend = answers.zip_trends("92101").filter("series = 'permits' and year = 2020").first()
    assert (trend["count"], trend["yoy_pct"]) == (10, 100.0)
    profile = answers.profile("92102").first()
    assert profile["area"] == "Other" and profile["demographics"]["median_income"] is None
    assert profile["civic_signals"]["crime_count"] is None
    assert answers.businesses(status="inactive").first()["business_name"] == "Gym"


def test_contract_breach_is_refused(spark):
    assert "momentum_scores" in CONTRACTS
    with pytest.raises(ValueError):
        check_contract("zip_centroids", spark.createDataFrame([("1", 1.0)], "zip_code string, lat double"))


CRIMES = "offense_group string, crime_against string, year bigint, count bigint, `a.b` string"


def folders_read(df):
    """Partition folders that the first scan of the executed plan opened."""
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numPartitions").value()


def test_one_period_is_read_from_a_table_stored_by_period(spark, tmp_path):
    rows = [(f"g{i % 5}" if i % 9 else None, f"k{i % 3}", 2010 + i % 7 if i % 4 else None, i, "x") for i in range(200)]
    rows += [("g1", "k1", 2016, 1, None)] * 100  # half of the dated rows are of the last year, repeated
    plain = spark.createDataFrame(rows, CRIMES)
    plain.write.parquet(str(tmp_path / "plain"))
    paths = partition_periods(spark, {"civic_crime_detail": str(tmp_path / "plain"), "civic_energy": "elsewhere"}, str(tmp_path / "stored"))
    assert paths["civic_energy"] == "elsewhere" and paths["civic_crime_detail"].endswith("stored/civic_crime_detail")
    stored = spark.read.schema(plain.schema).parquet(paths["civic_crime_detail"])
    key = lambda r: str(r)
    assert sorted(stored.select(*[f"`{c}`" for c in plain.columns]).collect(), key=key) == sorted(plain.collect(), key=key)
    for year in (None, 2012, 1900):
        old, new = (Answers({"civic_crime_detail": t}).crime_detail(year) for t in (plain, stored))
        assert sorted(map(str, old.collect())) == sorted(map(str, new.collect()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for found, want in ((latest(stored, "year"), 1), (stored.filter("year = 2012"), 1), (stored.filter("year >= 2015"), 2), (stored, 8)):
            found.collect()
            assert folders_read(found) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_an_empty_table_by_period(spark, tmp_path):
    empty = spark.createDataFrame([], CRIMES)
    opened = files.write_periods(empty, str(tmp_path / "none"), "year", ["offense_group"])
    assert opened.columns == empty.columns and opened.count() == 0 and latest(opened, "year").count() == 0
    assert files.read_table(spark, str(tmp_path / "none")) is None


def shuffles(plan):
    """Exchanges of the main plan, without those inside one-row subqueries."""
    return [line for line in plan.split("Subqueries")[0].splitlines() if "Exchange" in line and "BroadcastExchange" not in line]


@pytest.fixture
def no_broadcasts(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name in settings:
        spark.conf.unset(name)


def test_profiles_over_equal_buckets_need_no_shuffle(spark, domain, tmp_path, no_broadcasts):
    from standins.tables import AS_OF, CURRENT_YEAR, FIRST_YEAR, PEERS, PREVIOUS_YEAR

    source, store = bucketed_parts(spark, domain.source, str(tmp_path), buckets=3)
    graph = Tables(source, AS_OF, PREVIOUS_YEAR, CURRENT_YEAR, "last", FIRST_YEAR, store, PEERS)
    nested = profiles.nested_places(graph)
    plain = profiles.nested_places(domain.job_graph())
    explained = spark._jvm.PythonSQLUtils.explainString
    assert shuffles(explained(nested._jdf.queryExecution(), "formatted")) == []
    assert len(shuffles(explained(plain._jdf.queryExecution(), "formatted"))) > 5
    assert sorted(map(str, nested.collect())) == sorted(map(str, plain.collect()))
    for name in CO_LOCATED:  # one file per bucket at most, and all rows
        assert len(list((tmp_path / name).glob("*.parquet"))) <= 3
        assert graph[name].count() == domain.job_graph()[name].count()


def test_a_later_session_knows_the_buckets(spark, tmp_path, no_broadcasts):
    rows = spark.createDataFrame([("a", 1, 1.5), ("a", 2, None), (None, 3, 2.5), ("hot", 4, 1.0)] + [("hot", 4, 1.0)] * 50, "k string, n int, `x y` double")
    for name in ("left", "right"):
        files.write_bucketed(rows, str(tmp_path / name), "k", 4)
        spark.sql(f"DROP TABLE {files.bucketed_name(str(tmp_path / name))}")  # what a new session does not know
    left, right = (files.open_bucketed(spark, str(tmp_path / name), "k", 4) for name in ("left", "right"))
    assert sorted(map(str, left.collect())) == sorted(map(str, rows.collect()))
    joined = left.join(right.groupBy("k").count(), "k")
    assert shuffles(joined._jdf.queryExecution().executedPlan().toString()) == [] and joined.count() == 53
    assert files.open_bucketed(spark, str(tmp_path / "absent"), "k", 4) is None
    again = files.write_bucketed(rows.limit(1), str(tmp_path / "left"), "k", 4)  # replaced, not appended
    assert again.count() == 1


def test_a_build_with_buckets_gives_the_same_answers(spark, built, tmp_path):
    tables, target, config = built
    bucketed = build(spark, {**config, "buckets": 2}, str(tmp_path))
    assert set(bucketed) == set(tables)
    for name in tables:
        assert sorted(map(str, bucketed[name].collect())) == sorted(map(str, tables[name].select(*bucketed[name].columns).collect()))
    stored = StoredTables(spark, str(tmp_path), config["tables"], buckets=2)
    assert stored["business_by_zip"].count() == tables["business_by_zip"].count() and stored.get("civic_crime") is None
    answers = open_answers(spark, str(tmp_path), config["tables"], buckets=2)
    assert answers.profile("92102").first()["area"] == "Other"
