"""Builders of the cleaned and aggregated tables, and the job graph over them.

Places are keyed by ``zip_code`` and roll up to an ``area``.  Lookups (place name,
area, service plan) are input tables: no geography is part of the library.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicscope.functions import fixed_values as fixed
from civicscope.functions.classify import classify
from civicscope.functions.numbers import (
    per_thousand,
    round_half_up,
    weighted_mean,
)
from civicscope.functions.text import activity_status, estimate, parse_date, postal_key
from civicscope.operators import counts
from civicscope.operators.relations import (
    column_or,
    complete_mapping,
    find_column,
    hot_keys,
    settled,
    skew_join,
    typed_nulls,
)
from civicscope.operators.trends import momentum, momentum_by_group, yearly_series

KEY = "zip_code"

# Accepted header names of the business register, in order of preference.
REGISTER_COLUMNS = {
    "zip": ["ZIP", "zip", "zip_code"],
    "naics": ["NAICS", "naics", "naics_code"],
    "description": ["ACTIVITY DESC", "activity_desc", "naics_description", "DBA NAME", "dba_name"],
    "name": ["DBA NAME", "dba_name", "business_name"],
    "account": ["BUSINESS ACCT#", "business_acct", "account_key"],
    "start": ["START DT", "start_dt", "business_start_date"],
    "created": ["CREATION DT", "creation_dt", "date_cert_created"],
    "expires": ["EXP DT", "exp_dt", "date_cert_expired"],
    "address": ["ADDRESS", "address", "business_address"],
}

# Survey variables of the demographic source.
SURVEY_COLUMNS = {
    "population": ("B01003_001E", "int"),
    "median_age": ("B01002_001E", "float"),
    "median_income": ("B19013_001E", "int"),
    "median_home_value": ("B25077_001E", "int"),
    "median_rent": ("B25064_001E", "int"),
    "education_total": ("B15003_001E", "int"),
}
DEGREE_COLUMNS = ["B15003_022E", "B15003_023E", "B15003_024E", "B15003_025E"]
SURVEY_KEY = "zip code tabulation area"


def as_date(value: date | str | Column) -> Column:
    """The as-of date as a column; results never depend on the wall clock."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


# ---------------------------------------------------------------- cleaning


def businesses(
    raw: DataFrame,
    as_of: date | str | Column,
    prefixes: Mapping[str, str] = fixed.PREFIXES,
    sectors: Mapping[str, str] = fixed.SECTORS,
    rules=fixed.KEYWORDS,
    strict_nulls: bool = True,
) -> DataFrame:
    """Clean business records from an all-text register, exact duplicates removed."""
    if find_column(raw, *REGISTER_COLUMNS["zip"]) is None:
        raise ValueError("the register has no postal code column")

    def text(name: str, default: str | None = None) -> Column:
        return column_or(raw, REGISTER_COLUMNS[name], default, "string")

    def day(name: str) -> Column:
        return parse_date(text(name))

    described = find_column(raw, *REGISTER_COLUMNS["description"]) is not None
    rows = raw.select(
        text("account", "unknown").alias("account_id"),
        text("name", "unknown").alias("business_name"),
        text("address").alias("address"),
        postal_key(text("zip")).alias(KEY),
        text("naics").alias("naics_code"),
        text("description").alias("activity_description"),
        day("start").alias("start_date"),
        day("created").alias("created_date"),
        day("expires").alias("expiration_date"),
    )
    # Category and status follow from cleaned columns: duplicates go first, fewer rows are classified.
    cleaned = rows.filter(F.col(KEY).isNotNull()).dropDuplicates()
    described_by = F.col("activity_description") if described else F.lit("")
    category = classify(F.col("naics_code"), described_by, prefixes, sectors, rules, strict_nulls=strict_nulls)
    status = activity_status(F.col("expiration_date"), as_date(as_of))
    dates = ["start_date", "created_date", "expiration_date"]
    front = [c for c in cleaned.columns if c not in dates]
    return cleaned.select(*front, category.alias("category"), *dates, status.alias("status"))


def demographics(raw: DataFrame) -> DataFrame:
    """Survey estimates per place; the missing marker becomes NULL."""
    degrees = [F.coalesce(estimate(F.col(c)), F.lit(0)) for c in DEGREE_COLUMNS]
    bachelors = degrees[0] + degrees[1] + degrees[2] + degrees[3]
    columns = [estimate(F.col(c), t).alias(n) for n, (c, t) in SURVEY_COLUMNS.items()]
    share = round_half_up(F.col("bachelors_plus") * F.lit(100.0) / F.col("education_total"), 1)
    rows = raw.select(F.col(f"`{SURVEY_KEY}`").alias(KEY), *columns, bachelors.alias("bachelors_plus"))
    return rows.withColumn("pct_bachelors_plus", F.when(F.col("education_total") > 0, share))


def centroids(raw: DataFrame, profiled: DataFrame | None = None) -> DataFrame:
    """(key, lat, lng) from a gazetteer with padded headers and values."""
    names = {c.strip(): c for c in raw.columns}

    def cell(name: str) -> Column:
        return F.trim(raw[f"`{names[name]}`"])

    rows = raw.select(
        F.nullif(cell("GEOID"), F.lit("")).alias(KEY),
        cell("INTPTLAT").try_cast("double").alias("lat"),
        cell("INTPTLONG").try_cast("double").alias("lng"),
    ).dropna()
    if profiled is None:
        return rows
    return rows.join(profiled.select(KEY).distinct(), KEY, "left_semi")


# ---------------------------------------------------------------- profiles


def demographics_by_zip(demographic: DataFrame, business: DataFrame | None) -> DataFrame:
    """Demographics of the places that have businesses (all places without a business table)."""
    if business is None:
        return demographic
    return demographic.join(business.select(KEY).distinct(), KEY, "left_semi")


def plan_requests(civic_311: DataFrame) -> DataFrame:
    """Requests and request-weighted resolution days per service plan."""
    return civic_311.groupBy("comm_plan_name").agg(
        F.sum("total_requests").alias("total_311_requests"),
        weighted_mean(F.col("median_resolution_days"), F.col("total_requests"), 1).alias("median_311_days"),
    )


def neighborhood_profile(
    names: DataFrame,
    areas: DataFrame,
    as_of: date | str | Column,
    summary: DataFrame | None = None,
    demographic: DataFrame | None = None,
    permits: DataFrame | None = None,
    solar: DataFrame | None = None,
    crime: DataFrame | None = None,
    civic_311: DataFrame | None = None,
    plans: DataFrame | None = None,
    years: int = 2,
) -> DataFrame:
    """One row per named place: area, business counts, demographics and civic counts.

    Civic counts cover the calendar year of the as-of date and the ``years - 1``
    before.  Every source is aggregated to its key before it is joined; an absent
    source gives NULL columns.
    """
    first_year = F.year(as_date(as_of)) - (years - 1)
    rows = names.select(KEY, "neighborhood").join(areas.select(KEY, "area"), KEY, "left")
    rows = rows.withColumn("area", F.coalesce("area", F.lit("Other")))

    def recent(df: DataFrame, **sums: str) -> DataFrame:
        chosen = df.filter(F.col("year") >= first_year)
        return chosen.groupBy(KEY).agg(*[F.sum(c).alias(n) for n, c in sums.items()])

    def attach(left: DataFrame, right: DataFrame | None, columns: Mapping[str, str]) -> DataFrame:
        if right is None:
            return left.select("*", *typed_nulls(columns))
        return left.join(right.select(KEY, *columns), KEY, "left")

    rows = attach(
        rows, summary, {"active_count": "bigint", "total_count": "bigint", "category_count": "bigint"}
    )
    rows = attach(
        rows,
        demographic,
        {
            "population": "int",
            "median_age": "float",
            "median_income": "int",
            "median_home_value": "int",
            "median_rent": "int",
            "pct_bachelors_plus": "double",
        },
    )
    rows = rows.withColumn(
        "businesses_per_1k", per_thousand(F.col("active_count"), F.col("population"), 1)
    )
    rows = attach(
        rows,
        None if permits is None else recent(permits, new_permits="permit_count", permit_valuation="total_valuation"),
        {"new_permits": "bigint", "permit_valuation": "double"},
    )
    rows = attach(
        rows,
        None if solar is None else recent(solar, solar_installs="solar_count"),
        {"solar_installs": "bigint"},
    )
    rows = attach(
        rows, None if crime is None else recent(crime, crime_count="count"), {"crime_count": "bigint"}
    )
    requests = None
    if civic_311 is not None and plans is not None:
        by_plan = ["comm_plan_name"]
        requests = skew_join(plans, plan_requests(civic_311), by_plan, [KEY], hot_keys(plans, by_plan))
    return attach(rows, requests, {"median_311_days": "double", "total_311_requests": "bigint"})


def area_profile(profile: DataFrame, mapping: DataFrame) -> DataFrame:
    """Places rolled up to areas: sums, and means weighted by residents or requests."""
    people = F.col("population")

    def mean(name: str, digits: int) -> Column:
        return weighted_mean(F.col(name).cast("double"), people, digits).alias(name)

    joined = mapping.select(KEY, "area").join(profile.drop("area"), KEY)
    requests = F.col("total_311_requests")
    per_area = joined.groupBy("area").agg(
        F.count(F.lit(1)).alias("zip_count"),
        F.sum(people.cast("bigint")).alias("population"),
        mean("median_age", 1),
        mean("median_income", 0),
        mean("median_home_value", 0),
        mean("median_rent", 0),
        mean("pct_bachelors_plus", 1),
        F.sum("active_count").alias("active_count"),
        F.sum("total_count").alias("total_count"),
        F.sum("new_permits").alias("new_permits"),
        F.sum("permit_valuation").alias("permit_valuation"),
        F.sum("solar_installs").alias("solar_installs"),
        F.sum("crime_count").alias("crime_count"),
        weighted_mean(F.col("median_311_days"), requests, 1).alias("median_311_days"),
        F.sum(requests).alias("total_311_requests"),
    )
    return per_area.withColumn(
        "businesses_per_1k", per_thousand(F.col("active_count"), F.col("population"), 1)
    )


def area_categories(by_zip: DataFrame, mapping: DataFrame, areas: DataFrame) -> DataFrame:
    """Counts and rate per 1,000 residents for each (area, category)."""
    sums = (
        by_zip.join(mapping.select(KEY, "area"), KEY)
        .groupBy("area", "category")
        .agg(F.sum("active_count").alias("active_count"), F.sum("total_count").alias("total_count"))
    )
    joined = sums.join(areas.select("area", "population"), "area")
    rate = per_thousand(F.col("active_count"), F.col("population"), 2)
    return joined.select("area", "category", "active_count", "total_count", rate.alias("per_1k"))


def monthly_requests(monthly: DataFrame) -> DataFrame:
    """Month start split into year and month."""
    return monthly.select(
        F.year("request_month_start").alias("year"),
        F.month("request_month_start").alias("month"),
        "total_requests",
        "closed_requests",
        "avg_resolution_days",
        "median_resolution_days",
    )


def age_by_area(histogram: DataFrame, mapping: DataFrame, as_of: Column) -> DataFrame:
    """Age statistics per (area, category) over mapped places, from the place histogram."""
    located = histogram.join(mapping.select(KEY, "area"), KEY)
    regrouped = located.groupBy("area", "category", "start_date").agg(F.sum("n").alias("n"))
    return counts.age_statistics(regrouped, ["area", "category"], as_of)


# ---------------------------------------------------------------- job graph


# Source tables a build may use; an absent one makes its results NULL or absent.
SOURCES = [
    "names",
    "areas",
    "plans",
    "businesses",
    "demographics",
    "civic_permits",
    "civic_solar",
    "civic_crime",
    "civic_311",
    "civic_311_monthly",
    "civic_311_services",
    "civic_permit_timelines",
    "civic_energy",
    "civic_crime_detail",
    "civic_crime_temporal",
    "gazetteer",
    "map_311",
    "map_permits",
    "map_crime",
    "map_solar",
]


# Aggregates read by several tables.
SHARED = [
    "business_cube",
    "business_cells",
    "neighborhood_profile",
    "momentum_scores",
    "business_age_stats",
    "business_age_by_area",
    "place_percentiles",
]


def settle_shared(name: str, df: DataFrame) -> DataFrame:
    """Checkpoint the shared aggregates, leave other tables lazy."""
    return settled(df) if name in SHARED else df


#: What sentences call the average place and the average area.
PEERS = ("zip code", "area")


class Tables:
    """The job graph: each table is planned on first use and only once.

    ``source`` gives a source table by name, or None (``dict.get`` will do).  ``store``
    sees every finished table and returns the frame later tables read.  The default
    settles the aggregates that several tables share.  With ``one_scan`` the businesses
    are read once, for their cube, and all counts follow from it: right for a build of all
    tables; one table alone is quicker from the rows.  A source ``business_cube`` (one or
    several cubes, see ``incremental.extend_cube``) stands for the rows.
    ``files.parquet_store`` writes every table; None keeps one plan.  ``peers`` names the average place and area.
    """

    def __init__(
        self,
        source: Callable[[str], DataFrame | None],
        as_of: date | str,
        previous_year: int,
        current_year: int,
        null_policy: str = "last",
        first_year: int = 2015,
        store: Callable[[str, DataFrame], DataFrame] | None = settle_shared,
        peers: tuple[str, str] = PEERS,
        one_scan: bool = False,
    ) -> None:
        self._source = source
        self.one_scan = one_scan
        self.peers = peers
        self.as_of = as_date(as_of)
        self.previous_year = previous_year
        self.current_year = current_year
        self.null_policy = null_policy
        self.first_year = first_year
        self._store = store
        self._built: dict[str, DataFrame | None] = {}

    NAMES = [
        "zip_to_neighborhood",
        "businesses",
        "demographics",
        "business_cube",
        "business_cells",
        "business_by_zip",
        "business_summary",
        "demographics_by_zip",
        "neighborhood_profile",
        "city_averages",
        "zip_area",
        "area_profile",
        "area_business_by_category",
        "trend_business_formation",
        "trend_311_monthly",
        "start_histogram",
        "business_age_stats",
        "business_age_by_area",
        "yearly_series",
        "momentum_scores",
        "momentum_by_area",
        "zip_centroids",
        "place_percentiles",
        "place_profiles",
        "area_profiles",
    ]

    def get(self, name: str) -> DataFrame | None:
        """A table by name; None when its inputs are absent."""
        if name not in self._built:
            if name in self.NAMES:
                table = getattr(self, f"_{name}")()
                if table is not None and self._store is not None:
                    table = self._store(name, table)
            else:
                table = self._source(name)
            self._built[name] = table
        return self._built[name]

    def __getitem__(self, name: str) -> DataFrame:
        table = self.get(name)
        if table is None:
            raise KeyError(f"table {name} is not available")
        return table

    def build_all(self) -> dict[str, DataFrame]:
        """Every table whose inputs are present."""
        found = {name: self.get(name) for name in self.NAMES}
        return {name: table for name, table in found.items() if table is not None}

    # Builders; each returns None when a needed input is absent.

    def _place_percentiles(self):
        from civicscope.plans import profiles  # profiles are built from tables

        return None if self.get("neighborhood_profile") is None else profiles.ranked_places(self)

    def _place_profiles(self):
        from civicscope.plans import profiles

        return None if self.get("neighborhood_profile") is None else profiles.nested_places(self)

    def _area_profiles(self):
        from civicscope.plans import profiles

        return None if self.get("area_profile") is None else profiles.nested_areas(self)

    def _businesses(self):
        return self._source("businesses")

    def _demographics(self):
        return self._source("demographics")

    def _zip_to_neighborhood(self):
        return self["names"].select(KEY, "neighborhood")

    def _business_cube(self):
        ready = self._source("business_cube")
        if ready is not None:
            return counts.merged_cube(ready, KEY)
        rows = self.get("businesses")
        return None if rows is None else counts.business_cube(rows, KEY)

    def _counted(self) -> tuple[DataFrame | None, str | None]:
        """What counts start from: the cube and its count column, or the businesses."""
        if self.one_scan or self._source("business_cube") is not None:
            return self.get("business_cube"), "n"
        return self.get("businesses"), None

    def _business_cells(self):
        rows, n = self._counted()
        return None if rows is None else counts.business_cells(rows, KEY, n=n)

    def _business_by_zip(self):
        cells = self.get("business_cells")
        return None if cells is None else cells.select(KEY, "category", "total_count", "active_count")

    def _business_summary(self):
        cells = self.get("business_cells")
        return None if cells is None else counts.place_summary(cells, KEY)

    def _demographics_by_zip(self):
        rows = self.get("demographics")
        return None if rows is None else demographics_by_zip(rows, self.get("business_summary"))

    def _neighborhood_profile(self):
        civic = ["civic_permits", "civic_solar", "civic_crime", "civic_311", "plans"]
        return neighborhood_profile(
            self["names"],
            self["areas"],
            self.as_of,
            self.get("business_summary"),
            self.get("demographics"),
            *[self.get(name) for name in civic],
        )

    def _city_averages(self):
        return counts.city_averages(
            self.get("demographics"), self.get("business_summary"), self.get("neighborhood_profile"), KEY
        )

    def _zip_area(self):
        return complete_mapping(self["areas"], self["names"], KEY, "area")

    def _area_profile(self):
        return area_profile(self["neighborhood_profile"], self["zip_area"])

    def _area_business_by_category(self):
        rows = self.get("business_by_zip")
        if rows is None:
            return None
        return area_categories(rows, self["zip_area"], self["area_profile"])

    def _trend_business_formation(self):
        rows, n = self._counted()
        return None if rows is None else counts.formation(rows, KEY, self.first_year, n)

    def _trend_311_monthly(self):
        rows = self.get("civic_311_monthly")
        return None if rows is None else monthly_requests(rows)

    def _start_histogram(self):
        rows, n = self._counted()
        return None if rows is None else counts.start_histogram(rows, [KEY, "category"], n)

    def _business_age_stats(self):
        rows = self.get("start_histogram")
        return None if rows is None else counts.age_statistics(rows, [KEY, "category"], self.as_of)

    def _business_age_by_area(self):
        rows = self.get("start_histogram")
        return None if rows is None else age_by_area(rows, self["zip_area"], self.as_of)

    def _yearly_series(self):
        counted = {
            "business_formation": (self.get("trend_business_formation"), "new_businesses"),
            "permits": (self.get("civic_permits"), "permit_count"),
            "crime": (self.get("civic_crime"), "count"),
            "solar": (self.get("civic_solar"), "solar_count"),
        }
        present = {name: pair for name, pair in counted.items() if pair[0] is not None}
        return yearly_series(present, KEY) if present else None

    def _momentum_scores(self):
        universe = self.get("demographics_by_zip")
        if self.get("trend_business_formation") is None or universe is None:
            return None
        return momentum(
            self["yearly_series"], universe, KEY, self.previous_year, self.current_year, self.null_policy
        )

    def _momentum_by_area(self):
        scores = self.get("momentum_scores")
        if scores is None:
            return None
        return momentum_by_group(scores, self["demographics_by_zip"], self["zip_area"], KEY, "area")

    def _zip_centroids(self):
        raw = self.get("gazetteer")
        # Every named place has a profile, so the names stand for the profiled places.
        return None if raw is None else centroids(raw, self["zip_to_neighborhood"])
