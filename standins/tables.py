"""Domain tables derived from the driver tables by plain arithmetic.

A place (``zip_code``) is a supplier, an area is a supplier's nation (two nations
stay unmapped and become 'Other'), a business is a line item of the place, yearly
civic counts are line items by ship year, service requests are events.  So places,
businesses and points all grow with the data.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicscope.plans.answers import Answers
from civicscope.plans.tables import SOURCES, Tables, businesses, demographics, settle_shared

PEERS = ("sd zip code", "sd area")
AS_OF = "2001-08-01"
PREVIOUS_YEAR, CURRENT_YEAR = 1999, 2000
FIRST_YEAR = 1996
MISSING = "-666666666"

CATEGORIES = [
    "restaurant",
    "cafe & snack bar",
    "drinking places",
    "retail",
    "grocery",
    "dentist",
    "physician",
    "legal services",
    "auto repair",
    "child care",
    "construction",
    "other",
]
WORDS = [
    "corner bar",
    "yoga studio",
    "tax prep office",
    "Holiday Inn",
    "web development",
    "plain works",
    "pizza oven",
    "hair salon",
    "farmers market",
]


# Schemas of the driver tables; giving them spares a look into the files before planning.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def text(column: Column) -> Column:
    return column.cast("string")


def element(names: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (number % len(names) + 1).cast("int"))


def us_date(day: Column) -> Column:
    """Date text without leading zeros, month first."""
    return F.concat_ws("/", text(F.month(day)), text(F.dayofmonth(day)), text(F.year(day)))


class Domain:
    """Domain tables over one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._read: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        if name not in self._read:
            reader = self.spark.read.schema(SCHEMAS[name])
            self._read[name] = reader.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    # ------------------------------------------------------------ places

    @cached_property
    def supplier(self) -> DataFrame:
        return self.read("supplier").withColumn("zip_code", text(F.col("s_suppkey")))

    @cached_property
    def names(self) -> DataFrame:
        return self.supplier.select("zip_code", F.col("s_name").alias("neighborhood"))

    @cached_property
    def areas(self) -> DataFrame:
        nation = self.read("nation").filter(F.col("n_nationkey") < 23)
        joined = self.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        return joined.select("zip_code", F.col("n_name").alias("area"))

    @cached_property
    def plans(self) -> DataFrame:
        mapped = self.supplier.filter(F.col("s_acctbal") >= 1000)
        plan = F.concat(F.lit("Plan "), text(F.col("s_suppkey") % 30))
        return mapped.select("zip_code", plan.alias("comm_plan_name"))

    @cached_property
    def gazetteer(self) -> DataFrame:
        key = F.col("s_suppkey")
        lat = F.lit(32.5) + (key % 37) * F.lit(0.02)
        lng = F.lit(-117.2) + ((key * 7) % 41) * F.lit(0.02)
        blank = F.col("s_acctbal") > 9800

        def padded(value: Column) -> Column:
            return F.concat(F.lit("  "), text(value), F.lit("   "))

        return self.supplier.select(
            padded(key).alias("GEOID"),
            F.lit("0").alias("ALAND"),
            F.when(blank, "").otherwise(padded(lat)).alias("INTPTLAT"),
            padded(lng).alias("INTPTLONG   "),
        )

    @cached_property
    def census(self) -> DataFrame:
        key, money = F.col("s_suppkey"), F.col("s_acctbal")

        def number(column: Column, missing: Column) -> Column:
            return F.when(missing, MISSING).otherwise(text(column))

        never = F.lit(False)
        age = F.concat(text(25 + (key * 31) % 30), F.lit("."), text((key * 17) % 10))
        return self.supplier.filter(money >= -500).select(
            F.concat(F.lit("ZCTA5 "), F.col("zip_code")).alias("NAME"),
            number(1000 + (key * 7919) % 50000, money < -100).alias("B01003_001E"),
            age.alias("B01002_001E"),
            number(30000 + (key * 104729) % 120000, money > 9500).alias("B19013_001E"),
            number(200000 + (key * 15485863) % 1500000, never).alias("B25077_001E"),
            number(800 + (key * 611953) % 3000, money < 500).alias("B25064_001E"),
            number(500 + (key * 3571) % 30000, never).alias("B15003_001E"),
            number((key * 13) % 120, never).alias("B15003_022E"),
            number((key * 29) % 110, never).alias("B15003_023E"),
            number((key * 7) % 30, money > 9000).alias("B15003_024E"),
            number((key * 3) % 20, never).alias("B15003_025E"),
            F.col("zip_code").alias("zip code tabulation area"),
        )

    # ------------------------------------------------------------ businesses

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.read("lineitem").withColumns(
            {"zip_code": text(F.col("l_suppkey")), "year": F.year("l_shipdate")}
        )

    @cached_property
    def register(self) -> DataFrame:
        """Raw register: text columns only, some codes blank, some dates impossible."""
        part = self.read("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
        rows = self.read("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
        size, day = F.col("p_size"), F.col("l_shipdate").cast("date")
        kind = size % 6
        two = F.lpad(text(size), 2, "0")
        code = (
            F.when(kind == 1, F.concat(two, F.lit("1990")))
            .when(kind == 2, F.concat(F.lit("7225"), two))
            .when(kind == 3, F.concat(F.lit("812"), text(size % 10), F.lit("00")))
            .when(kind == 4, F.concat(F.lit("99"), two))
            .when(kind == 5, F.concat(F.lit(" 541"), text(size % 10), F.lit(".0")))
        )
        five = F.lpad(text(F.col("l_suppkey") % 100000), 5, "0")
        four = F.lpad(text(F.col("l_orderkey") % 10000), 4, "0")
        start = F.when(F.col("l_quantity") == 50, "13/45/2020").otherwise(us_date(day))
        ends = F.when(F.col("l_linestatus") == "F", us_date(F.date_add(day, 730)))
        return rows.select(
            F.concat_ws("-", text(F.col("l_orderkey")), text(F.col("l_linenumber"))).alias("BUSINESS ACCT#"),
            F.col("p_name").alias("DBA NAME"),
            F.concat_ws(" ", text(F.col("l_linenumber")), F.col("p_brand")).alias("ADDRESS"),
            F.concat_ws("-", five, four).alias("ZIP"),
            code.alias("NAICS"),
            F.concat_ws(" ", "p_type", "p_name", element(WORDS, F.col("p_partkey"))).alias("ACTIVITY DESC"),
            start.alias("START DT"),
            us_date(day).alias("CREATION DT"),
            ends.alias("EXP DT"),
        )

    @cached_property
    def cleaned_register(self) -> DataFrame:
        return businesses(self.register, AS_OF)

    @cached_property
    def businesses(self) -> DataFrame:
        """Business table as the register cleaning would leave it, straight from line items."""
        day = F.col("l_shipdate").cast("date")
        ends = F.when(F.col("l_linestatus") == "F", F.date_add(day, 730))
        known = F.when(F.col("l_quantity") != 50, element(CATEGORIES, F.col("l_partkey")))
        return self.lineitem.select(
            F.concat_ws("-", text(F.col("l_orderkey")), text(F.col("l_linenumber")), text(F.col("l_partkey"))).alias(
                "account_id"
            ),
            F.concat(F.lit("Business "), text(F.col("l_partkey"))).alias("business_name"),
            F.concat(text(F.col("l_linenumber")), F.lit(" Main Street")).alias("address"),
            "zip_code",
            text(722500 + F.col("l_partkey") % 12).alias("naics_code"),
            known.alias("activity_description"),
            known.alias("category"),
            day.alias("start_date"),
            day.alias("created_date"),
            ends.alias("expiration_date"),
            F.when(ends.isNull() | (ends >= F.lit(AS_OF).cast("date")), "active").otherwise("inactive").alias("status"),
        )

    # ------------------------------------------------------------ civic tables

    @property
    def _kind(self) -> Column:
        return F.when(F.col("l_returnflag") == "A", "Person").when(F.col("l_returnflag") == "R", "Property").otherwise("Society")

    @property
    def _dollars(self) -> Column:
        return F.floor("l_extendedprice").cast("bigint")

    @cached_property
    def civic_permits(self) -> DataFrame:
        return self.lineitem.groupBy("zip_code", "year").agg(
            F.sum(F.col("l_quantity").cast("bigint")).alias("permit_count"),
            F.sum(self._dollars).cast("double").alias("total_valuation"),
            F.sum(F.col("l_linenumber").cast("bigint")).alias("total_du"),
        )

    @cached_property
    def civic_solar(self) -> DataFrame:
        return self.lineitem.filter(F.col("l_discount") >= 0.05).groupBy("zip_code", "year").agg(
            F.count(F.lit(1)).alias("solar_count"),
            F.sum(self._dollars).cast("double").alias("total_valuation"),
        )

    @cached_property
    def civic_crime(self) -> DataFrame:
        return self.lineitem.groupBy("zip_code", self._kind.alias("crime_against"), "year").agg(
            F.count(F.lit(1)).alias("count")
        )

    @cached_property
    def civic_311(self) -> DataFrame:
        plan = F.concat(F.lit("Plan "), text(F.col("user_id") % 25)).alias("comm_plan_name")
        cents = F.sum(F.floor(F.col("value") * F.lit(100.0)).cast("bigint"))
        return self.read("events").groupBy(plan, "event_type").agg(
            F.count(F.lit(1)).alias("total_requests"),
            (cents / F.lit(100.0) / F.count(F.lit(1))).alias("median_resolution_days"),
        )

    @cached_property
    def civic_311_monthly(self) -> DataFrame:
        days = F.floor(F.col("o_totalprice") / F.lit(1000.0)).cast("int")
        start = F.date_trunc("month", "o_orderdate").cast("date").alias("request_month_start")
        return self.read("orders").groupBy(start).agg(
            F.count(F.lit(1)).alias("total_requests"),
            F.count_if(F.col("o_orderstatus") == "F").alias("closed_requests"),
            (F.sum(days) / F.count(F.lit(1))).alias("avg_resolution_days"),
            F.median(days).alias("median_resolution_days"),
        )

    @cached_property
    def civic_311_services(self) -> DataFrame:
        days = F.floor("value").cast("int")
        closed = F.count_if(F.col("value") > 20)
        return self.read("events").groupBy(F.col("event_type").alias("service_name")).agg(
            F.count(F.lit(1)).alias("total_requests"),
            closed.alias("closed_requests"),
            (F.sum(days) / F.count(F.lit(1))).alias("avg_resolution_days"),
            F.median(days).alias("median_resolution_days"),
            (closed * F.lit(100.0) / F.count(F.lit(1))).alias("close_rate_pct"),
        )

    @cached_property
    def civic_permit_timelines(self) -> DataFrame:
        orders = self.read("orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
        rows = self.lineitem.select("l_orderkey", "zip_code", "year", "l_shipdate").join(
            orders, F.col("l_orderkey") == F.col("o_orderkey")
        )
        days = F.abs(F.datediff(F.col("l_shipdate"), F.col("o_orderdate")))
        counted = rows.groupBy("year", F.col("o_orderpriority").alias("approval_type_clean"), "zip_code", days.alias("days")).agg(
            F.count(F.lit(1)).alias("n")
        )
        total = F.sum("n")
        return counted.groupBy("year", "approval_type_clean", "zip_code").agg(
            total.alias("permit_count"),
            F.percentile(F.col("days"), 0.5, F.col("n")).alias("median_days"),
            (F.sum(F.col("days") * F.col("n")) / total).alias("avg_days"),
            F.percentile(F.col("days"), 0.9, F.col("n")).alias("p90_days"),
        )

    @cached_property
    def civic_energy(self) -> DataFrame:
        total, customers = F.sum(self._dollars), F.count(F.lit(1))
        return self.lineitem.groupBy("zip_code", "year").agg(
            total.alias("total_kwh"),
            customers.alias("elec_customers"),
            (total / customers).alias("avg_kwh_per_customer"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("total_thm"),
            F.count_if(F.col("l_tax") > 0.04).alias("gas_customers"),
        )

    @cached_property
    def civic_crime_detail(self) -> DataFrame:
        return self.lineitem.groupBy(
            F.concat(F.col("l_linestatus"), F.lit(" "), F.col("l_returnflag")).alias("offense_group"),
            F.concat(F.lit("offence "), text(F.col("l_linenumber"))).alias("offense_description"),
            self._kind.alias("crime_against"),
            "year",
        ).agg(F.count(F.lit(1)).alias("count"))

    @cached_property
    def civic_crime_temporal(self) -> DataFrame:
        return self.lineitem.groupBy(
            F.weekday("l_shipdate").alias("dow"),
            F.month("l_shipdate").alias("month"),
            "year",
            self._kind.alias("crime_against"),
        ).agg(F.count(F.lit(1)).alias("count"))

    # ------------------------------------------------------------ map layers

    @staticmethod
    def _point(a: str, b: str) -> list[Column]:
        return [
            (F.lit(32.5) + (F.col(a) % 97) * F.lit(0.003)).alias("lat"),
            (F.lit(-117.2) + (F.col(b) % 89) * F.lit(0.003)).alias("lng"),
        ]

    @cached_property
    def map_311(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_id").alias("point_id"),
            *self._point("event_id", "user_id"),
            F.col("event_type").alias("service_name"),
            F.year("ts").alias("request_year"),
        )

    @cached_property
    def map_permits(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_orderkey").alias("point_id"),
            *self._point("o_orderkey", "o_custkey"),
            F.col("o_orderpriority").alias("approval_type_clean"),
            F.year("o_orderdate").alias("approval_year"),
            F.col("o_totalprice").alias("valuation"),
            (F.col("o_orderpriority") == "1-URGENT").alias("is_solar"),
        )

    @cached_property
    def map_crime(self) -> DataFrame:
        return self.lineitem.select(
            *self._point("l_orderkey", "l_partkey"), self._kind.alias("crime_against"), "year"
        )

    @cached_property
    def map_solar(self) -> DataFrame:
        return self.lineitem.filter(F.col("l_discount") >= 0.05).select(
            *self._point("l_partkey", "l_orderkey"), "year", F.col("l_extendedprice").alias("valuation"), "zip_code"
        )

    # ------------------------------------------------------------ job graph

    def source(self, name: str) -> DataFrame | None:
        """A source table of the job graph by name."""
        if name == "demographics":
            return demographics(self.census)
        return getattr(self, name) if name in SOURCES else None

    def job_graph(self, store=settle_shared, null_policy: str = "last") -> Tables:
        return Tables(self.source, AS_OF, PREVIOUS_YEAR, CURRENT_YEAR, null_policy, FIRST_YEAR, store, PEERS)

    @cached_property
    def tables(self) -> Tables:
        return self.job_graph()

    @cached_property
    def answers(self) -> Answers:
        return Answers(self.tables)
