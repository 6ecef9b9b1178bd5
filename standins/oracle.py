"""SQL oracles for the registered queries, written independently of the Spark plans."""

from __future__ import annotations

import re

from civicscope.functions import fixed_values as fixed
from standins.tables import CATEGORIES, WORDS

AS_OF = "DATE '2001-08-01'"


def py(value: str, digits: int = 1) -> str:
    """Half-to-even rounding of the exact binary value."""
    return f"(CAST(format('{{:.{digits}f}}', CAST({value} AS DOUBLE)) AS DOUBLE) + 0)"


def fixed_text(value: str, digits: int = 0) -> str:
    return f"format('{{:.{digits}f}}', CAST({value} AS DOUBLE))"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(names: list[str], number: str) -> str:
    listed = ", ".join(quoted(n) for n in names)
    return f"list_extract([{listed}], CAST(({number}) % {len(names)} + 1 AS BIGINT))"


def values(table: dict[str, str]) -> str:
    return ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in table.items())


def keyword_case(text: str) -> str:
    whens = [
        "WHEN " + " OR ".join(f"contains(lower({text}), {quoted(w)})" for w in words) + f" THEN {quoted(c)}"
        for words, c in fixed.KEYWORDS
    ]
    return "CASE " + " ".join(whens) + " END"


KIND = "CASE l_returnflag WHEN 'A' THEN 'Person' WHEN 'R' THEN 'Property' ELSE 'Society' END"
ZIP = "CAST(l_suppkey AS VARCHAR)"
YEAR = "CAST(year(l_shipdate) AS INTEGER)"
DOLLARS = "CAST(floor(l_extendedprice) AS BIGINT)"
US_DATE = "month({0}) || '/' || day({0}) || '/' || year({0})"


def point(a: str, b: str) -> str:
    return (
        f"CAST(32.5 AS DOUBLE) + ({a} % 97) * CAST(0.003 AS DOUBLE) AS lat, "
        f"CAST(-117.2 AS DOUBLE) + ({b} % 89) * CAST(0.003 AS DOUBLE) AS lng"
    )


def missing(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN NULL ELSE CAST({value} AS INTEGER) END"


def yearly_change(table: str, count: str, factor: str, name: str) -> str:
    return f"""
        SELECT zip_code, CASE WHEN p > 0 THEN ROUND({factor} * (c - p) / p, 1) + 0 END AS {name}
        FROM (SELECT zip_code, SUM(CASE WHEN year = 1999 THEN {count} ELSE 0 END) AS p,
                     SUM(CASE WHEN year = 2000 THEN {count} ELSE 0 END) AS c
              FROM {table} WHERE year IN (1999, 2000) GROUP BY zip_code)
        WHERE p > 0 OR c > 0"""


def age_columns() -> str:
    days = f"datediff('day', start_date, {AS_OF})"
    return f"""COUNT(*) AS business_count,
        ROUND(MEDIAN({days}) / 365.25e0, 1) AS median_age_years,
        ROUND(AVG({days}) / 365.25e0, 1) + 0 AS avg_age_years,
        ROUND(1e2 * SUM(CASE WHEN {days} < 730 THEN 1 ELSE 0 END) / COUNT(*), 1) AS pct_under_2yr,
        ROUND(1e2 * SUM(CASE WHEN {days} > 3652 THEN 1 ELSE 0 END) / COUNT(*), 1) AS pct_over_10yr"""


def w_mean(value: str, weight: str = "population", digits: int = 1) -> str:
    return f"ROUND(SUM(CAST({value} AS DOUBLE) * {weight}) / NULLIF(CAST(SUM({weight}) AS DOUBLE), 0), {digits})"


PROFILE_METRICS = [m for m in fixed.PERCENTILE_METRICS if m != "momentum_score"]


def percentile_part(table: str, metric: str) -> str:
    direction = "DESC" if fixed.PERCENTILE_METRICS[metric] else "ASC"
    return f"""SELECT zip_code, '{metric}' AS metric, CAST({metric} AS DOUBLE) AS value,
        RANK() OVER (ORDER BY {metric} {direction} NULLS LAST) AS rank,
        COUNT({metric}) OVER () AS of FROM {table}"""


SERIES = {
    "business_formation": ("t_formation", "new_businesses"),
    "permits": ("t_permits", "permit_count"),
    "crime": ("t_crime", "count"),
    "solar": ("t_solar", "solar_count"),
}


def yoy(partition: str) -> str:
    previous = f"LAG(count) OVER (PARTITION BY {partition} ORDER BY year)"
    change = f"(count - {previous}) * 1e2 / NULLIF(ABS(CAST({previous} AS DOUBLE)), 0)"
    return f"{py(change)} AS yoy_pct"


CTE = {
    "t_names": "SELECT CAST(s_suppkey AS VARCHAR) AS zip_code, s_name AS neighborhood FROM supplier",
    "t_areas": """SELECT CAST(s_suppkey AS VARCHAR) AS zip_code, n_name AS area
        FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey < 23""",
    "t_plans": """SELECT CAST(s_suppkey AS VARCHAR) AS zip_code, 'Plan ' || (s_suppkey % 30) AS comm_plan_name
        FROM supplier WHERE s_acctbal >= 1000""",
    "t_cent": """SELECT CAST(s_suppkey AS VARCHAR) AS zip_code,
        CAST(32.5 AS DOUBLE) + (s_suppkey % 37) * CAST(0.02 AS DOUBLE) AS lat,
        CAST(-117.2 AS DOUBLE) + ((s_suppkey * 7) % 41) * CAST(0.02 AS DOUBLE) AS lng
        FROM supplier WHERE s_acctbal <= 9800""",
    "t_demo_raw": f"""SELECT CAST(s_suppkey AS VARCHAR) AS zip_code,
        {missing('s_acctbal < -100', '1000 + (s_suppkey * 7919) % 50000')} AS population,
        CAST((25 + (s_suppkey * 31) % 30) || '.' || ((s_suppkey * 17) % 10) AS FLOAT) AS median_age,
        {missing('s_acctbal > 9500', '30000 + (s_suppkey * 104729) % 120000')} AS median_income,
        CAST(200000 + (s_suppkey * 15485863) % 1500000 AS INTEGER) AS median_home_value,
        {missing('s_acctbal < 500', '800 + (s_suppkey * 611953) % 3000')} AS median_rent,
        CAST(500 + (s_suppkey * 3571) % 30000 AS INTEGER) AS education_total,
        CAST((s_suppkey * 13) % 120 + (s_suppkey * 29) % 110
             + CASE WHEN s_acctbal > 9000 THEN 0 ELSE (s_suppkey * 7) % 30 END
             + (s_suppkey * 3) % 20 AS INTEGER) AS bachelors_plus
        FROM supplier WHERE s_acctbal >= -500""",
    "t_demo": """SELECT *, CASE WHEN education_total > 0
        THEN ROUND(1e2 * bachelors_plus / education_total, 1) END AS pct_bachelors_plus FROM t_demo_raw""",
    "t_biz": f"""SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS account_id,
        'Business ' || l_partkey AS business_name, l_linenumber || ' Main Street' AS address,
        {ZIP} AS zip_code, CAST(722500 + l_partkey % 12 AS VARCHAR) AS naics_code,
        CASE WHEN l_quantity <> 50 THEN {pick(CATEGORIES, 'l_partkey')} END AS activity_description,
        CASE WHEN l_quantity <> 50 THEN {pick(CATEGORIES, 'l_partkey')} END AS category,
        CAST(l_shipdate AS DATE) AS start_date, CAST(l_shipdate AS DATE) AS created_date,
        CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) + 730 END AS expiration_date,
        CASE WHEN l_linestatus <> 'F' OR CAST(l_shipdate AS DATE) + 730 >= {AS_OF}
             THEN 'active' ELSE 'inactive' END AS status FROM lineitem""",
    "t_permits": f"""SELECT {ZIP} AS zip_code, {YEAR} AS year,
        CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS permit_count,
        CAST(SUM({DOLLARS}) AS DOUBLE) AS total_valuation FROM lineitem GROUP BY ALL""",
    "t_solar": f"""SELECT {ZIP} AS zip_code, {YEAR} AS year, COUNT(*) AS solar_count
        FROM lineitem WHERE l_discount >= CAST(0.05 AS DOUBLE) GROUP BY ALL""",
    "t_crime": f"""SELECT {ZIP} AS zip_code, {KIND} AS crime_against, {YEAR} AS year, COUNT(*) AS count
        FROM lineitem GROUP BY ALL""",
    "t_311": """SELECT 'Plan ' || (user_id % 25) AS comm_plan_name, event_type, COUNT(*) AS total_requests,
        CAST(SUM(CAST(floor(value * 1e2) AS BIGINT)) AS DOUBLE) / 1e2 / COUNT(*) AS median_resolution_days
        FROM events GROUP BY ALL""",
    "t_energy": f"""SELECT {ZIP} AS zip_code, {YEAR} AS year, CAST(SUM({DOLLARS}) AS BIGINT) AS total_kwh,
        COUNT(*) AS elec_customers, CAST(SUM({DOLLARS}) AS DOUBLE) / COUNT(*) AS avg_kwh_per_customer
        FROM lineitem GROUP BY ALL""",
    "t_timelines": f"""SELECT {YEAR} AS year, o_orderpriority AS approval_type_clean, {ZIP} AS zip_code,
        COUNT(*) AS permit_count,
        MEDIAN(ABS(datediff('day', o_orderdate, l_shipdate))) AS median_days
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
    "t_detail": f"""SELECT l_linestatus || ' ' || l_returnflag AS offense_group, {KIND} AS crime_against,
        {YEAR} AS year, COUNT(*) AS count FROM lineitem GROUP BY ALL""",
    "t_temporal": f"""SELECT CAST(isodow(l_shipdate) - 1 AS INTEGER) AS dow, CAST(month(l_shipdate) AS INTEGER) AS month,
        {YEAR} AS year, {KIND} AS crime_against, COUNT(*) AS count FROM lineitem GROUP BY ALL""",
    "t_raw": f"""SELECT l_orderkey || '-' || l_linenumber AS account_id, p_name AS business_name,
        l_linenumber || ' ' || p_brand AS address,
        lpad(CAST(l_suppkey % 100000 AS VARCHAR), 5, '0') || '-' || lpad(CAST(l_orderkey % 10000 AS VARCHAR), 4, '0') AS zip,
        CASE p_size % 6 WHEN 1 THEN lpad(CAST(p_size AS VARCHAR), 2, '0') || '1990'
            WHEN 2 THEN '7225' || lpad(CAST(p_size AS VARCHAR), 2, '0')
            WHEN 3 THEN '812' || (p_size % 10) || '00'
            WHEN 4 THEN '99' || lpad(CAST(p_size AS VARCHAR), 2, '0')
            WHEN 5 THEN ' 541' || (p_size % 10) || '.0' END AS naics,
        p_type || ' ' || p_name || ' ' || {pick(WORDS, 'p_partkey')} AS description,
        CASE WHEN l_quantity = 50 THEN '13/45/2020' ELSE {US_DATE.format('l_shipdate')} END AS start_text,
        {US_DATE.format('l_shipdate')} AS created_text,
        CASE WHEN l_linestatus = 'F' THEN {US_DATE.format('(CAST(l_shipdate AS DATE) + 730)')} END AS end_text
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "t_prefix": f"SELECT * FROM (VALUES {values(fixed.PREFIXES)}) AS v(code, category)",
    "t_sector": f"SELECT * FROM (VALUES {values(fixed.SECTORS)}) AS v(code, category)",
    "t_class": f"""SELECT k.naics, k.description,
        COALESCE(p0.category, p5.category, p4.category, p3.category, s.category,
                 {keyword_case('k.description')}, 'other') AS loose
        FROM (SELECT DISTINCT naics, description, split_part(trim(naics), '.', 1) AS code FROM t_raw) k
        LEFT JOIN t_prefix p0 ON p0.code = k.code
        LEFT JOIN t_prefix p5 ON p5.code = left(k.code, 5)
        LEFT JOIN t_prefix p4 ON p4.code = left(k.code, 4)
        LEFT JOIN t_prefix p3 ON p3.code = left(k.code, 3)
        LEFT JOIN t_sector s ON s.code = left(k.code, 2)""",
    "t_clean": f"""SELECT DISTINCT account_id, business_name, address,
        left(regexp_replace(zip, '[^0-9]', '', 'g'), 5) AS zip_code, r.naics AS naics_code,
        r.description AS activity_description, CASE WHEN r.naics IS NOT NULL THEN c.loose END AS category,
        CAST(try_strptime(start_text, '%m/%d/%Y') AS DATE) AS start_date,
        CAST(try_strptime(created_text, '%m/%d/%Y') AS DATE) AS created_date,
        CAST(try_strptime(end_text, '%m/%d/%Y') AS DATE) AS expiration_date,
        CASE WHEN end_text IS NULL OR try_strptime(end_text, '%m/%d/%Y') >= {AS_OF}
             THEN 'active' ELSE 'inactive' END AS status
        FROM t_raw r JOIN t_class c ON r.naics IS NOT DISTINCT FROM c.naics AND r.description = c.description
        WHERE LENGTH(regexp_replace(zip, '[^0-9]', '', 'g')) >= 5""",
    "t_by_zip": """SELECT zip_code, category, COUNT(*) AS total_count,
        COUNT(*) FILTER (WHERE status = 'active') AS active_count FROM t_biz GROUP BY zip_code, category""",
    "t_summary": """SELECT zip_code, COUNT(*) AS total_count,
        COUNT(*) FILTER (WHERE status = 'active') AS active_count, COUNT(DISTINCT category) AS category_count,
        MIN(start_date) AS earliest_start, MAX(start_date) AS latest_start FROM t_biz GROUP BY zip_code""",
    "t_demo_zip": "SELECT * FROM t_demo WHERE zip_code IN (SELECT zip_code FROM t_biz)",
    "t_plan_sum": f"""SELECT comm_plan_name, CAST(SUM(total_requests) AS BIGINT) AS total_311_requests,
        {w_mean('median_resolution_days', 'total_requests')} AS median_311_days FROM t_311 GROUP BY comm_plan_name""",
    "t_profile": """SELECT n.zip_code, n.neighborhood, COALESCE(a.area, 'Other') AS area,
        s.active_count, s.total_count, s.category_count, d.population, d.median_age, d.median_income,
        d.median_home_value, d.median_rent, d.pct_bachelors_plus,
        ROUND(1e3 * s.active_count / NULLIF(d.population, 0), 1) AS businesses_per_1k,
        p.new_permits, p.permit_valuation, so.solar_installs, c.crime_count,
        r.median_311_days, r.total_311_requests
        FROM t_names n LEFT JOIN t_areas a ON n.zip_code = a.zip_code
        LEFT JOIN t_summary s ON n.zip_code = s.zip_code LEFT JOIN t_demo d ON n.zip_code = d.zip_code
        LEFT JOIN (SELECT zip_code, CAST(SUM(permit_count) AS BIGINT) AS new_permits,
                   SUM(total_valuation) AS permit_valuation
                   FROM t_permits WHERE year >= 2000 GROUP BY zip_code) p ON n.zip_code = p.zip_code
        LEFT JOIN (SELECT zip_code, CAST(SUM(solar_count) AS BIGINT) AS solar_installs
                   FROM t_solar WHERE year >= 2000 GROUP BY zip_code) so ON n.zip_code = so.zip_code
        LEFT JOIN (SELECT zip_code, CAST(SUM(count) AS BIGINT) AS crime_count
                   FROM t_crime WHERE year >= 2000 GROUP BY zip_code) c ON n.zip_code = c.zip_code
        LEFT JOIN t_plans pl ON n.zip_code = pl.zip_code
        LEFT JOIN t_plan_sum r ON pl.comm_plan_name = r.comm_plan_name""",
    "t_map": """SELECT zip_code, area FROM t_areas UNION ALL
        SELECT zip_code, 'Other' FROM t_names WHERE zip_code NOT IN (SELECT zip_code FROM t_areas)""",
    "t_area": f"""SELECT m.area, COUNT(DISTINCT m.zip_code) AS zip_count,
        CAST(SUM(population) AS BIGINT) AS population, {w_mean('median_age')} AS median_age,
        {w_mean('median_income', digits=0)} AS median_income, {w_mean('median_home_value', digits=0)} AS median_home_value,
        {w_mean('median_rent', digits=0)} AS median_rent, {w_mean('pct_bachelors_plus')} AS pct_bachelors_plus,
        CAST(SUM(active_count) AS BIGINT) AS active_count, CAST(SUM(total_count) AS BIGINT) AS total_count,
        ROUND(1e3 * SUM(active_count) / NULLIF(SUM(population), 0), 1) AS businesses_per_1k,
        CAST(SUM(new_permits) AS BIGINT) AS new_permits, SUM(permit_valuation) AS permit_valuation,
        CAST(SUM(solar_installs) AS BIGINT) AS solar_installs, CAST(SUM(crime_count) AS BIGINT) AS crime_count,
        {w_mean('median_311_days', 'total_311_requests')} AS median_311_days,
        CAST(SUM(total_311_requests) AS BIGINT) AS total_311_requests
        FROM t_map m JOIN t_profile p ON m.zip_code = p.zip_code GROUP BY m.area""",
    "t_area_cat": """SELECT m.area, b.category, CAST(SUM(b.active_count) AS BIGINT) AS active_count,
        CAST(SUM(b.total_count) AS BIGINT) AS total_count,
        ROUND(1e3 * SUM(b.active_count) / NULLIF(ap.population, 0), 2) AS per_1k
        FROM t_map m JOIN t_by_zip b ON m.zip_code = b.zip_code JOIN t_area ap ON m.area = ap.area
        GROUP BY m.area, b.category, ap.population""",
    "t_avg": """SELECT AVG(population) AS avg_population, AVG(median_age) AS avg_median_age,
        AVG(median_income) AS avg_median_income, AVG(median_home_value) AS avg_median_home_value,
        AVG(median_rent) AS avg_median_rent, AVG(pct_bachelors_plus) AS avg_pct_bachelors_plus,
        (SELECT AVG(active_count) FROM t_summary WHERE zip_code IN (SELECT zip_code FROM t_demo)) AS avg_active_businesses,
        (SELECT AVG(total_count) FROM t_summary WHERE zip_code IN (SELECT zip_code FROM t_demo)) AS avg_total_businesses,
        (SELECT AVG(category_count) FROM t_summary WHERE zip_code IN (SELECT zip_code FROM t_demo)) AS avg_category_count,
        (SELECT ROUND(AVG(1e3 * active_count / NULLIF(population, 0)), 1) FROM t_profile
         WHERE population > 0 AND active_count IS NOT NULL) AS avg_businesses_per_1k,
        (SELECT AVG(crime_count) FROM t_profile) AS avg_crime_count,
        (SELECT AVG(median_311_days) FROM t_profile) AS avg_median_311_days,
        (SELECT AVG(new_permits) FROM t_profile) AS avg_new_permits,
        (SELECT AVG(solar_installs) FROM t_profile) AS avg_solar_installs FROM t_demo""",
    "t_formation": """SELECT zip_code, CAST(year(start_date) AS INTEGER) AS year, COUNT(*) AS new_businesses
        FROM t_biz WHERE start_date IS NOT NULL AND year(start_date) >= 1996 GROUP BY ALL""",
    "t_age_zip": f"""SELECT zip_code, category, {age_columns()} FROM t_biz
        WHERE start_date IS NOT NULL AND status = 'active' GROUP BY zip_code, category HAVING COUNT(*) >= 3""",
    "t_age_area": f"""SELECT m.area, b.category, {age_columns()} FROM t_biz b JOIN t_map m ON b.zip_code = m.zip_code
        WHERE start_date IS NOT NULL AND status = 'active' GROUP BY m.area, b.category HAVING COUNT(*) >= 3""",
    "t_series": " UNION ALL ".join(
        f"SELECT zip_code, '{s}' AS series, year, CAST({c} AS BIGINT) AS count FROM {t}" for s, (t, c) in SERIES.items()
    ),
    "t_zip_trend": f"""SELECT zip_code, series, year, count, {yoy('zip_code, series')} FROM
        (SELECT zip_code, series, year, CAST(SUM(count) AS BIGINT) AS count FROM t_series GROUP BY ALL)""",
    "t_area_trend": f"""SELECT area, series, year, count, {yoy('area, series')} FROM
        (SELECT area, series, year, CAST(SUM(count) AS BIGINT) AS count
         FROM t_series JOIN t_map USING (zip_code) GROUP BY ALL)""",
    "t_yb": yearly_change("t_formation", "new_businesses", "1e2", "biz_formation_yoy"),
    "t_yp": yearly_change("t_permits", "permit_count", "1e2", "permit_yoy"),
    "t_yc": yearly_change("t_crime", "count", "-1e2", "crime_yoy"),
    "t_ys": yearly_change("t_solar", "solar_count", "1e2", "solar_yoy"),
    "t_change": """SELECT z.zip_code, biz_formation_yoy, permit_yoy, crime_yoy, solar_yoy
        FROM (SELECT zip_code FROM t_demo_zip WHERE zip_code IN (SELECT zip_code FROM t_yb)
              OR zip_code IN (SELECT zip_code FROM t_yp) OR zip_code IN (SELECT zip_code FROM t_yc)
              OR zip_code IN (SELECT zip_code FROM t_ys)) z
        LEFT JOIN t_yb USING (zip_code) LEFT JOIN t_yp USING (zip_code)
        LEFT JOIN t_yc USING (zip_code) LEFT JOIN t_ys USING (zip_code)""",
    "t_momentum": """SELECT zip_code, ROUND(
        PERCENT_RANK() OVER (ORDER BY biz_formation_yoy NULLS LAST) * 25
        + PERCENT_RANK() OVER (ORDER BY permit_yoy NULLS LAST) * 25
        + PERCENT_RANK() OVER (ORDER BY crime_yoy NULLS LAST) * 25
        + PERCENT_RANK() OVER (ORDER BY solar_yoy NULLS LAST) * 25, 1) AS momentum_score,
        biz_formation_yoy, permit_yoy, crime_yoy, solar_yoy FROM t_change""",
    "t_mom_area": "SELECT m.area, "
    + w_mean("momentum_score")
    + " AS momentum_score, "
    + ", ".join(
        f"""ROUND(SUM({c} * CAST(d.population AS DOUBLE))
        / NULLIF(SUM(CASE WHEN {c} IS NOT NULL THEN CAST(d.population AS DOUBLE) ELSE 0 END), 0), 1) + 0 AS {c}"""
        for c in ["biz_formation_yoy", "permit_yoy", "crime_yoy", "solar_yoy"]
    )
    + """ FROM t_momentum s JOIN t_demo_zip d ON s.zip_code = d.zip_code
        JOIN t_map m ON s.zip_code = m.zip_code GROUP BY m.area""",
    "t_pct": "SELECT zip_code, metric, value, rank, of, CAST("
    + py("1e2 * (of - rank) / greatest(of - 1, 1)", 0)
    + " AS INTEGER) AS percentile FROM ("
    + " UNION ALL ".join(percentile_part("t_profile", m) for m in PROFILE_METRICS)
    + " UNION ALL "
    + percentile_part("t_momentum", "momentum_score")
    + ") WHERE value IS NOT NULL",
    "t_city": """SELECT category, ROUND(1e3 * SUM(active_count) / NULLIF((SELECT SUM(population) FROM t_demo_zip), 0), 2)
        AS city_per_1k FROM t_by_zip WHERE zip_code IN (SELECT zip_code FROM t_demo_zip) GROUP BY category""",
    "t_city_profiled": """SELECT category,
        ROUND(1e3 * SUM(active_count) / (SELECT SUM(population) FROM t_profile WHERE population > 0), 2) AS city_per_1k
        FROM t_by_zip WHERE zip_code IN (SELECT zip_code FROM t_profile WHERE population > 0) GROUP BY category""",
    "t_top_cat": f"""SELECT b.zip_code, CAST(b.position AS INTEGER) AS position, b.category, b.active_count, b.total_count,
        CASE WHEN p.population > 0 THEN {py('1e3 * b.active_count / p.population')} END AS per_1k,
        {py('c.city_per_1k')} AS city_avg_per_1k
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY zip_code ORDER BY active_count DESC, category NULLS FIRST)
              AS position FROM t_by_zip) b
        LEFT JOIN t_profile p ON b.zip_code = p.zip_code LEFT JOIN t_city_profiled c ON b.category = c.category
        WHERE b.position <= 10""",
    "t_rates": """SELECT b.zip_code, b.category, b.active_count,
        CASE WHEN p.population > 0 THEN ROUND(1e3 * b.active_count / p.population, 2) END AS per_1k, p.neighborhood
        FROM t_by_zip b JOIN t_profile p ON b.zip_code = p.zip_code""",
    "t_density": f"""SELECT b.zip_code, b.category, b.active_count AS count,
        CASE WHEN p.population > 0 THEN {py('1e3 * b.active_count / p.population', 2)} END AS density,
        {py('c.city_per_1k')} AS city_avg_density
        FROM t_by_zip b LEFT JOIN t_profile p ON b.zip_code = p.zip_code LEFT JOIN t_city c ON b.category = c.category
        WHERE b.category IS NOT NULL""",
    "t_near": f"""SELECT r.zip_code, r.neighborhood, r.active_count, {py('r.per_1k')} AS per_1k, z.lat, z.lng
        FROM t_rates r JOIN t_cent z ON r.zip_code = z.zip_code, (SELECT lat, lng FROM t_cent WHERE zip_code = '7') c
        WHERE r.category = 'restaurant' AND r.active_count > 0
          AND ABS(z.lat - c.lat) <= CAST(0.1 AS DOUBLE) AND ABS(z.lng - c.lng) <= CAST(0.1 AS DOUBLE)
        ORDER BY r.active_count DESC, r.zip_code LIMIT 20""",
    "t_pairs": """SELECT CAST(s_suppkey AS VARCHAR) AS zip_code_a, CAST(s_suppkey + 1 AS VARCHAR) AS zip_code_b
        FROM supplier""",
    "t_area_pairs": """SELECT a.n_name AS area_a, b.n_name AS area_b FROM nation a
        JOIN nation b ON b.n_nationkey = (a.n_nationkey + 1) % 25""",
    "t_vs": " UNION ALL ".join(
        f"SELECT zip_code, '{m}' AS metric, CAST({m} AS DOUBLE) AS v, {a} AS a FROM t_profile, t_avg"
        for m, a in fixed.AVERAGE_OF.items()
    ),
    "t_area_vs": " UNION ALL ".join(
        f"SELECT area, '{m}' AS metric, CAST({m} AS DOUBLE) AS v, {a} AS a FROM t_area, t_avg"
        for m, a in fixed.AVERAGE_OF.items()
    ),
    "t_h2h": "SELECT zip_code_a, zip_code_b, metric, value_a, value_b, "
    + py("value_a - value_b")
    + " AS difference FROM ("
    + " UNION ALL ".join(
        f"""SELECT zip_code_a, zip_code_b, '{m}' AS metric, {py('a.' + m)} AS value_a, {py('b.' + m)} AS value_b
        FROM t_pairs JOIN t_profile a ON a.zip_code = zip_code_a JOIN t_profile b ON b.zip_code = zip_code_b"""
        for m in fixed.PLACE_COMPARISON
    )
    + ")",
    "t_latest_crime": """SELECT zip_code, year, crime_against, count FROM t_crime c
        WHERE year = (SELECT MAX(year) FROM t_crime x WHERE x.zip_code = c.zip_code)""",
}


def with_tables(body: str) -> str:
    """Prefix a statement with the CTEs it needs."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in re.findall(r"\bt_\w+\b", sql):
            if name in CTE and name not in needed:
                needed.add(name)
                visit(CTE[name])

    visit(body)
    parts = [f"{name} AS ({sql})" for name, sql in CTE.items() if name in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


# ---------------------------------------------------------------- rankings


def place_ranking(metric: str, direction: str, limit: int, source: str = "t_profile", context=None) -> str:
    context = context or [c for c in ["population", "median_income", "active_count"] if c != metric]
    extra = "".join(f", {c}" for c in context)
    return f"""SELECT CAST(ROW_NUMBER() OVER (ORDER BY {metric} {direction} NULLS LAST, zip_code) AS INTEGER) AS rank,
        zip_code, neighborhood, {metric} AS sort_value{extra}, '{metric}' AS sort_metric
        FROM {source} WHERE {metric} IS NOT NULL ORDER BY rank LIMIT {limit}"""


CATEGORY_JOIN = """(SELECT p.*, COALESCE(b.active_count, 0) AS category_active,
        CASE WHEN p.population > 0 THEN ROUND(1e3 * COALESCE(b.active_count, 0) / p.population, 2) END AS rate
        FROM t_profile p LEFT JOIN t_by_zip b ON p.zip_code = b.zip_code AND b.category = 'restaurant')"""


# ---------------------------------------------------------------- sentences


def growth(score: str) -> str:
    shown = py(score)
    number = f"CASE WHEN {shown} = floor({shown}) THEN CAST(CAST({shown} AS BIGINT) AS VARCHAR) ELSE CAST({shown} AS VARCHAR) END"
    band = f"""CASE WHEN {score} >= 60 THEN 'strong growth trajectory'
        WHEN {score} >= 40 THEN 'moderate growth' ELSE 'slower growth period' END"""
    return f"'momentum score: ' || {number} || '/100 (' || {band} || ')'"


AGE_TAIL = """COALESCE('. most common business type (' || COALESCE(g.category, 'None') || ') has median age of '
        || CAST(g.median_age_years AS VARCHAR) || ' years', '')"""


def first_age(table: str, key: str) -> str:
    return f"""(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {key}
        ORDER BY business_count DESC, category NULLS FIRST) AS n FROM {table}) WHERE n = 1)"""


def place_narrative() -> str:
    rows = " UNION ALL ".join(
        f"""SELECT zip_code, {i} AS pos, {quoted(label)} AS label, '{sense}' AS sense, '{less}' AS less,
        {py('p.' + m)} / NULLIF({py('a.' + a)}, 0) AS r FROM t_profile p, t_avg a"""
        for i, (m, a, label, sense, less) in enumerate(fixed.PLACE_SENTENCE)
    )
    return f"""SELECT p.zip_code, CASE WHEN k.zip_code IS NULL THEN 'close to city average across most metrics' ELSE
        'compared to the avg sd zip code: ' || concat_ws(' — ' || 'but ', k.good, k.bad)
        || COALESCE('. ' || {growth('s.momentum_score')}, '') || {AGE_TAIL} END AS narrative
        FROM t_profile p LEFT JOIN t_momentum s ON p.zip_code = s.zip_code
        LEFT JOIN {first_age('t_age_zip', 'zip_code')} g ON p.zip_code = g.zip_code
        LEFT JOIN (SELECT zip_code, string_agg(clause, ', ' ORDER BY n) FILTER (WHERE good) AS good,
                          string_agg(clause, ', ' ORDER BY n) FILTER (WHERE NOT good) AS bad
                   FROM (SELECT zip_code, (r > 1) = (sense = 'good') AS good,
                        CASE WHEN r > 10 THEN 'far more ' || label
                             WHEN r >= 2 THEN {fixed_text('r')} || 'x the ' || label
                             WHEN r > 1.1e0 THEN {fixed_text('(r - 1) * 100')} || '% more ' || label
                             WHEN r < 0.1e0 THEN 'far ' || less || ' ' || label
                             WHEN r < 0.5e0 THEN '1/' || {fixed_text('1 / r')} || ' the ' || label
                             ELSE {fixed_text('(1 - r) * 100')} || '% ' || less || ' ' || label END AS clause,
                        ROW_NUMBER() OVER (PARTITION BY zip_code ORDER BY ABS(r - 1) DESC, pos) AS n
                        FROM ({rows}) WHERE r IS NOT NULL AND NOT (r >= 0.9e0 AND r <= 1.1e0))
                   WHERE n <= 5 GROUP BY zip_code) k ON p.zip_code = k.zip_code"""


def area_narrative() -> str:
    rows = " UNION ALL ".join(
        f"""SELECT area, {i} AS pos, {quoted(label)} AS label, '{sense}' AS sense, '{less}' AS less,
        CAST(p.{m} AS DOUBLE) / NULLIF(a.{a}, 0) AS r FROM t_area p, t_avg a"""
        for i, (m, a, label, sense, less) in enumerate(fixed.AREA_SENTENCE)
    )
    prefix = """lower(p.area) || ' (' || p.zip_count || ' zip codes'
        || COALESCE(CASE WHEN p.population <> 0 THEN ', pop ' || format('{:,}', p.population) END, '') || ')'"""
    return f"""SELECT p.area, CASE WHEN k.area IS NULL THEN {prefix} || ' is close to city average across most metrics.' ELSE
        'compared to the avg sd area: ' || {prefix} || ' has '
        || concat_ws(' — ', k.good, CASE WHEN k.good IS NOT NULL THEN 'but ' || k.bad ELSE k.bad END) || '.'
        || COALESCE(' ' || {growth('s.momentum_score')}, '') || {AGE_TAIL} END AS narrative
        FROM t_area p LEFT JOIN t_mom_area s ON p.area = s.area
        LEFT JOIN {first_age('t_age_area', 'area')} g ON p.area = g.area
        LEFT JOIN (SELECT area, string_agg(clause, ', ' ORDER BY n) FILTER (WHERE good) AS good,
                          string_agg(clause, ', ' ORDER BY n) FILTER (WHERE NOT good) AS bad
                   FROM (SELECT area, (r > 1) = (sense = 'good') AS good,
                        CASE WHEN r > 10 THEN {fixed_text('r')} || 'x'
                             WHEN r > 0 AND r < 0.1e0 THEN '1/' || {fixed_text('1 / r')} || 'th the'
                             WHEN r >= 2 THEN {fixed_text('r', 1)} || 'x'
                             WHEN r > 1 THEN {fixed_text('(r - 1) * 100')} || '% more'
                             ELSE {fixed_text('(1 - r) * 100')} || '% ' || less END || ' ' || label AS clause,
                        ROW_NUMBER() OVER (PARTITION BY area ORDER BY ABS(r - 1) DESC, pos) AS n
                        FROM ({rows}) WHERE r IS NOT NULL AND NOT (r >= 0.9e0 AND r <= 1.1e0))
                   WHERE n <= 5 GROUP BY area) k ON p.area = k.area"""


def pair_narrative() -> str:
    rows = " UNION ALL ".join(
        f"""SELECT zip_code_a, zip_code_b, {i} AS pos, {quoted(label)} AS label, '{sense}' AS sense, '{less}' AS less,
        {py('a.' + m)} AS a, {py('b.' + m)} AS b
        FROM t_pairs JOIN t_profile a ON a.zip_code = zip_code_a JOIN t_profile b ON b.zip_code = zip_code_b"""
        for i, (m, _, label, sense, less) in enumerate(fixed.PLACE_SENTENCE)
    )
    return f"""SELECT q.zip_code_a, q.zip_code_b, CASE WHEN wa IS NULL AND wb IS NULL
        THEN x.neighborhood || ' and ' || y.neighborhood || ' are similar across most metrics'
        ELSE concat_ws(' — ', x.neighborhood || ' has ' || wa, y.neighborhood || ' has ' || wb) END AS narrative
        FROM t_pairs q JOIN t_profile x ON x.zip_code = q.zip_code_a JOIN t_profile y ON y.zip_code = q.zip_code_b
        LEFT JOIN (SELECT zip_code_a, string_agg(clause, ', ' ORDER BY n) FILTER (WHERE a_wins) AS wa,
                          string_agg(clause, ', ' ORDER BY n) FILTER (WHERE NOT a_wins) AS wb
            FROM (SELECT zip_code_a, a_wins, size || CASE WHEN sense = 'good' THEN ' more ' ELSE ' ' || less || ' ' END
                         || label AS clause,
                         ROW_NUMBER() OVER (PARTITION BY zip_code_a, a_wins ORDER BY score DESC, pos) AS n
                  FROM (SELECT *, (a > b) = (sense = 'good') AS a_wins,
                        ABS(a - b) / greatest(ABS(a), ABS(b), 1) AS score,
                        CASE WHEN least(a, b) <= 0 OR greatest(a, b) / NULLIF(least(a, b), 0) > 10 THEN 'far'
                             WHEN greatest(a, b) / least(a, b) >= 2 THEN {fixed_text('greatest(a, b) / least(a, b)')} || 'x'
                             ELSE {fixed_text('(greatest(a, b) / least(a, b) - 1) * 100')} || '%' END AS size
                        FROM ({rows}) WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b))
            WHERE n <= 3 GROUP BY zip_code_a) w ON w.zip_code_a = q.zip_code_a"""


def area_pair_narrative() -> str:
    rows = " UNION ALL ".join(
        f"""SELECT area_a, area_b, {quoted(label)} AS label, '{sense}' AS sense, {py('a.' + m)} / NULLIF({py('b.' + m)}, 0) AS r
        FROM t_area_pairs JOIN t_area a ON a.area = area_a JOIN t_area b ON b.area = area_b"""
        for m, label, sense in fixed.AREA_PAIR_SENTENCE
        if sense != "neutral"
    )
    return f"""SELECT q.area_a, q.area_b, CASE WHEN wa IS NULL AND wb IS NULL
        THEN lower(q.area_a) || ' and ' || lower(q.area_b) || ' are similar across most metrics.'
        ELSE concat_ws(' — ', lower(q.area_a) || ' has ' || wa, lower(q.area_b) || ' has ' || wb) || '.' END AS narrative
        FROM t_area_pairs q JOIN t_area x ON x.area = q.area_a JOIN t_area y ON y.area = q.area_b
        LEFT JOIN (SELECT area_a, string_agg(clause, ', ' ORDER BY n) FILTER (WHERE a_wins) AS wa,
                          string_agg(clause, ', ' ORDER BY n) FILTER (WHERE NOT a_wins) AS wb
            FROM (SELECT area_a, a_wins, clause,
                         ROW_NUMBER() OVER (PARTITION BY area_a, a_wins ORDER BY pct DESC, clause DESC) AS n
                  FROM (SELECT area_a, (r > 1) = (sense = 'good') AS a_wins, ABS(r - 1) * 100 AS pct,
                        {fixed_text('ABS(r - 1) * 100')} || CASE WHEN r > 1 THEN '% more ' ELSE '% fewer ' END || label AS clause
                        FROM ({rows}) WHERE r IS NOT NULL AND NOT (r >= 0.9e0 AND r <= 1.1e0)))
            WHERE n <= 3 GROUP BY area_a) w ON w.area_a = q.area_a"""


def metric_names(table: dict[str, str], wanted: str) -> str:
    return ", ".join(f"'{m}'" for m, s in table.items() if s == wanted)


def hexagon() -> str:
    import math

    metres = 111320.0
    x = f"(lng - CAST(-117.2 AS DOUBLE)) * CAST({metres * math.cos(math.radians(32.5))!r} AS DOUBLE)"
    y = f"(lat - CAST(32.5 AS DOUBLE)) * CAST({metres!r} AS DOUBLE)"
    a, b, c = math.sqrt(3) / 3 / 100.0, 1 / 3 / 100.0, 2 / 3 / 100.0
    return f"""SELECT year,
        CASE WHEN dq > dr AND dq > ds THEN -r0 - s0 ELSE q0 END AS hex_q,
        CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -q0 - s0 ELSE r0 END AS hex_r, COUNT(*) AS points
        FROM (SELECT year, q0, r0, s0, ABS(q0 - q) AS dq, ABS(r0 - r) AS dr, ABS(s0 - s) AS ds FROM
          (SELECT *, CAST(floor(q + 0.5e0) AS BIGINT) AS q0, CAST(floor(r + 0.5e0) AS BIGINT) AS r0,
                  CAST(floor(s + 0.5e0) AS BIGINT) AS s0 FROM
            (SELECT *, -q - r AS s FROM
              (SELECT year, {x} * CAST({a!r} AS DOUBLE) - {y} * CAST({b!r} AS DOUBLE) AS q, {y} * CAST({c!r} AS DOUBLE) AS r
               FROM (SELECT {YEAR} AS year, {point('l_orderkey', 'l_partkey')} FROM lineitem)))))
        GROUP BY ALL"""


def six(expression: str, name: str) -> str:
    return f"ROUND({expression}, 6) AS {name}"


AVERAGE_COLUMNS = ["avg_population", "avg_median_age", "avg_median_income", "avg_median_home_value",
                   "avg_median_rent", "avg_pct_bachelors_plus", "avg_active_businesses", "avg_total_businesses",
                   "avg_category_count", "avg_businesses_per_1k", "avg_crime_count", "avg_median_311_days",
                   "avg_new_permits", "avg_solar_installs"]

AGES = "category, business_count, median_age_years, avg_age_years, pct_under_2yr, pct_over_10yr"


def top_ages(table: str, key: str) -> str:
    return f"""SELECT {key}, {AGES}, CAST(n AS INTEGER) AS position FROM (SELECT *, ROW_NUMBER() OVER (
        PARTITION BY {key} ORDER BY business_count DESC, category NULLS FIRST) AS n FROM {table}) WHERE n <= 15"""


def versus(table: str, key: str) -> str:
    return f"""SELECT {key}, metric, {py('v')} AS value, {py('a')} AS city_avg,
        {py('1e2 * (v - a) / ABS(a)')} AS vs_avg_pct FROM {table} WHERE v IS NOT NULL AND a IS NOT NULL AND a <> 0"""


LATEST_TIMELINES = """(SELECT * FROM t_timelines t WHERE permit_count > 0 AND year =
        (SELECT MAX(year) FROM t_timelines x WHERE x.zip_code = t.zip_code AND permit_count > 0))"""

BODY = {
    "category_counts": "SELECT * FROM t_by_zip",
    "place_summary": "SELECT * FROM t_summary",
    "filter_values": """SELECT DISTINCT 'zip_code' AS dimension, zip_code AS value FROM t_profile
        UNION ALL SELECT DISTINCT 'category', category FROM t_by_zip WHERE category IS NOT NULL
        UNION ALL SELECT DISTINCT 'area', area FROM t_area
        UNION ALL SELECT * FROM (VALUES ('status', 'active'), ('status', 'inactive'))""",
    "semi_filter": "SELECT zip_code, population, median_income FROM t_demo_zip",
    "anti_unmapped": "SELECT * FROM t_map",
    "keys_in_any": """SELECT zip_code, neighborhood FROM t_names
        WHERE zip_code IN (SELECT zip_code FROM t_solar WHERE year BETWEEN 2001 AND 2001)
           OR zip_code IN (SELECT zip_code FROM t_plans)""",
    "weighted_mean_total": f"""SELECT area, {w_mean('median_rent')} AS median_rent
        FROM t_map JOIN t_demo USING (zip_code) GROUP BY area""",
    "weighted_mean_nonnull": """SELECT area, ROUND(SUM(CAST(median_rent AS DOUBLE) * population)
        / NULLIF(SUM(CASE WHEN median_rent IS NOT NULL THEN CAST(population AS DOUBLE) ELSE 0 END), 0), 1) AS median_rent
        FROM t_map JOIN t_demo USING (zip_code) GROUP BY area""",
    "share_pct": """SELECT category, ROUND(1e2 * SUM(CASE WHEN status = 'active' THEN 1 ELSE 0 END) / COUNT(*), 1)
        AS pct_active FROM t_biz GROUP BY category""",
    "density_per_1k": "SELECT zip_code, category, active_count, per_1k FROM t_rates",
    "city_density": "SELECT * FROM t_city",
    "ordered_list": """SELECT zip_code, COALESCE(string_agg(category, ',' ORDER BY category), '') AS categories
        FROM t_by_zip GROUP BY zip_code""",
    "median_age": f"""SELECT category, {age_columns()} FROM t_biz
        WHERE start_date IS NOT NULL AND status = 'active' GROUP BY category""",
    "dedup": "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders",
    "zip_normalise": """SELECT left(regexp_replace(zip, '[^0-9]', '', 'g'), 5) AS zip_code, COUNT(*) AS rows
        FROM t_raw GROUP BY ALL""",
    "date_parse": """SELECT CAST(try_strptime(start_text, '%m/%d/%Y') AS DATE) AS start_date, COUNT(*) AS rows
        FROM t_raw GROUP BY ALL""",
    "sentinel_null": "SELECT zip_code, population, median_income, median_rent, bachelors_plus FROM t_demo",
    "classify_code": """SELECT p_partkey,
        COALESCE(a4.category, s.category) AS by_code, COALESCE(b6.category, 'restaurant') AS by_prefix
        FROM part LEFT JOIN t_prefix a4 ON a4.code = left(p_size || '110', 4)
        LEFT JOIN t_sector s ON s.code = left(p_size || '110', 2)
        LEFT JOIN t_prefix b6 ON b6.code = '72251' || left(CAST(p_size AS VARCHAR), 1)""",
    "classify_text": f"SELECT doc_id, {keyword_case('text')} AS category FROM documents",
    "classify_record": """SELECT CASE WHEN r.naics IS NOT NULL THEN c.loose END AS category,
        c.loose AS category_loose, COUNT(*) AS rows
        FROM t_raw r JOIN t_class c ON r.naics IS NOT DISTINCT FROM c.naics AND r.description = c.description
        GROUP BY ALL""",
    "status_flag": "SELECT status, expiration_date, COUNT(*) AS rows FROM t_clean GROUP BY ALL",
    "businesses": "SELECT * FROM t_clean",
    "demographics_table": "SELECT * FROM t_demo",
    "neighborhood_profile": "SELECT * FROM t_profile",
    "area_profile": "SELECT * FROM t_area",
    "area_categories": "SELECT * FROM t_area_cat",
    "city_averages": "SELECT " + ", ".join(six(c, c) for c in AVERAGE_COLUMNS) + " FROM t_avg",
    "formation_trend": "SELECT * FROM t_formation",
    "monthly_trend": """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
        COUNT(*) AS total_requests, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS closed_requests,
        ROUND(AVG(CAST(floor(o_totalprice / 1e3) AS INTEGER)), 6) AS avg_resolution_days,
        MEDIAN(CAST(floor(o_totalprice / 1e3) AS INTEGER)) AS median_resolution_days FROM orders GROUP BY 1, 2""",
    "age_by_place": "SELECT * FROM t_age_zip",
    "distinct_rollup": """SELECT 'area' AS scope, area, COUNT(DISTINCT business_name) AS distinct_names, TRUE AS within_bound
        FROM t_biz JOIN t_map USING (zip_code) GROUP BY area UNION ALL
        SELECT 'city', NULL, COUNT(DISTINCT business_name), TRUE FROM t_biz""",
    "median_rollup": " UNION ALL ".join(
        f"""SELECT '{scope}' AS scope, {area} AS area, COUNT(*) AS business_count,
        ROUND(MEDIAN(datediff('day', start_date, {AS_OF})) / 365.25e0, 1) AS median_age_years, TRUE AS within_bound
        FROM t_biz {join} WHERE start_date IS NOT NULL AND status = 'active' {group}"""
        for scope, area, join, group in [
            ("area", "area", "JOIN t_map USING (zip_code)", "GROUP BY area"),
            ("city", "CAST(NULL AS VARCHAR)", "", ""),
        ]
    ),
    "age_by_area": "SELECT * FROM t_age_area",
    "momentum": "SELECT * FROM t_momentum",
    "momentum_neutral": "SELECT zip_code, ROUND("
    + " + ".join(
        f"""COALESCE(CASE WHEN {c} IS NULL THEN NULL WHEN COUNT({c}) OVER () > 1
        THEN CAST(RANK() OVER (ORDER BY {c} NULLS LAST) - 1 AS DOUBLE) / (COUNT({c}) OVER () - 1) ELSE 0 END * 25, 12.5e0)"""
        for c in ["biz_formation_yoy", "permit_yoy", "crime_yoy", "solar_yoy"]
    )
    + """, 1) AS momentum_score, biz_formation_yoy, permit_yoy, crime_yoy, solar_yoy FROM t_change""",
    "momentum_by_area": "SELECT * FROM t_mom_area",
    "zip_centroids": "SELECT * FROM t_cent",
    "name_lookup": "SELECT * FROM t_names",
    "percentiles": "SELECT * FROM t_pct",
    "rankings": place_ranking("businesses_per_1k", "DESC", 50),
    "rankings_momentum": place_ranking(
        "momentum_score", "DESC", 50, "(SELECT * FROM t_profile JOIN t_momentum USING (zip_code))"
    ),
    "rankings_category": f"""SELECT CAST(ROW_NUMBER() OVER (ORDER BY rate DESC NULLS LAST, zip_code) AS INTEGER) AS rank,
        zip_code, neighborhood, {py('rate')} AS sort_value, {py('rate')} AS category_per_1k, category_active,
        population, median_income, active_count, 'category_per_1k' AS sort_metric, 'restaurant' AS category
        FROM {CATEGORY_JOIN} ORDER BY rank LIMIT 50""",
    "rankings_category_context": f"""SELECT CAST(ROW_NUMBER() OVER (ORDER BY median_rent, zip_code) AS INTEGER) AS rank,
        zip_code, neighborhood, median_rent AS sort_value, category_active, {py('rate')} AS category_per_1k,
        population, median_income, active_count, 'median_rent' AS sort_metric, 'restaurant' AS category
        FROM {CATEGORY_JOIN} WHERE median_rent IS NOT NULL ORDER BY rank LIMIT 50""",
    "rankings_display": """SELECT zip_code, neighborhood, population, median_income, active_count
        FROM t_profile WHERE population IS NOT NULL ORDER BY population DESC, zip_code LIMIT 30""",
    "area_rankings": """SELECT CAST(ROW_NUMBER() OVER (ORDER BY crime_count NULLS LAST, area) AS INTEGER) AS rank, area,
        crime_count AS sort_value, population, median_income, active_count, 'crime_count' AS sort_metric
        FROM t_area ORDER BY rank LIMIT 20""",
    "area_rankings_category": f"""SELECT CAST(ROW_NUMBER() OVER (ORDER BY c.per_1k DESC NULLS LAST, a.area) AS INTEGER) AS rank,
        a.area, {py('c.per_1k')} AS sort_value, a.population, a.median_income, a.active_count,
        c.active_count AS category_active, {py('c.per_1k')} AS category_per_1k, 'category_per_1k' AS sort_metric,
        'restaurant' AS category FROM t_area a LEFT JOIN t_area_cat c ON a.area = c.area AND c.category = 'restaurant'
        ORDER BY rank LIMIT 20""",
    "top_n_per_place": """SELECT zip_code, category, total_count, active_count, CAST(n AS INTEGER) AS position
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY zip_code ORDER BY active_count DESC, category NULLS FIRST) AS n
              FROM t_by_zip) WHERE n <= 3""",
    "top_categories": "SELECT * FROM t_top_cat",
    "area_top_categories": f"""SELECT a.area, CAST(n AS INTEGER) AS position, a.category, a.active_count, a.total_count,
        {py('a.per_1k')} AS per_1k, {py('c.city_per_1k')} AS city_avg_per_1k
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY area ORDER BY active_count DESC, category NULLS FIRST) AS n
              FROM t_area_cat) a LEFT JOIN t_city c ON a.category = c.category WHERE n <= 10""",
    "momentum_top": "SELECT * FROM t_momentum ORDER BY momentum_score DESC, zip_code LIMIT 20",
    "area_momentum_top": "SELECT * FROM t_mom_area ORDER BY momentum_score DESC, area LIMIT 20",
    "business_age": top_ages("t_age_zip", "zip_code"),
    "area_business_age": top_ages("t_age_area", "area"),
    "place_trends": "SELECT * FROM t_zip_trend",
    "area_trends": "SELECT * FROM t_area_trend",
    "city_trends": f"""SELECT series, year, {py('count')} AS count, yoy_pct FROM
        (SELECT series, year, count, {yoy('series')} FROM (SELECT series, year,
         ROUND(SUM(count) * 1e0 / COUNT(DISTINCT zip_code), 1) AS count FROM t_series GROUP BY series, year))""",
    "latest_yoy": """SELECT zip_code, series, year, count, yoy_pct FROM (SELECT *, ROW_NUMBER() OVER (
        PARTITION BY zip_code, series ORDER BY year DESC) AS n FROM t_zip_trend) WHERE n = 1""",
    "yoy_text": f"""SELECT area, series, CASE WHEN yoy_pct >= 0 THEN '+' ELSE '-' END
        || {fixed_text('ABS(yoy_pct)')} || '% yoy' AS change FROM (SELECT *, ROW_NUMBER() OVER (
        PARTITION BY area, series ORDER BY year DESC) AS n FROM t_area_trend) WHERE n = 1""",
    "two_year_change": "SELECT zip_code, "
    + ", ".join(
        f"""CASE WHEN SUM(count) FILTER (WHERE series = '{s}' AND year = 1998) > 0 THEN ROUND({f} *
        (COALESCE(SUM(count) FILTER (WHERE series = '{s}' AND year = 2000), 0)
         - SUM(count) FILTER (WHERE series = '{s}' AND year = 1998))
        / SUM(count) FILTER (WHERE series = '{s}' AND year = 1998), 1) + 0 END AS {n}"""
        for s, n, f in [
            ("business_formation", "biz_formation_yoy", "1e2"),
            ("permits", "permit_yoy", "1e2"),
            ("crime", "crime_yoy", "-1e2"),
            ("solar", "solar_yoy", "1e2"),
        ]
    )
    + " FROM t_series WHERE year IN (1998, 2000) GROUP BY zip_code HAVING SUM(count) > 0",
    "series_span": """SELECT zip_code, series, MIN(year) AS first_year, MAX(year) AS last_year
        FROM t_series GROUP BY zip_code, series""",
    "map_points": f"""SELECT * FROM (SELECT o_orderkey AS point_id, {point('o_orderkey', 'o_custkey')},
        o_orderpriority AS approval_type_clean, CAST(year(o_orderdate) AS INTEGER) AS approval_year,
        o_totalprice AS valuation, o_orderpriority = '1-URGENT' AS is_solar FROM orders)
        WHERE approval_year BETWEEN 1997 AND 2000
          AND lat BETWEEN 32.6e0 - 0.05e0 AND 32.6e0 + 0.05e0 AND lng BETWEEN -117.1e0 - 0.05e0 AND -117.1e0 + 0.05e0
        """,
    "map_points_all": f"""SELECT o_orderkey AS point_id, {point('o_orderkey', 'o_custkey')},
        o_orderpriority AS approval_type_clean, CAST(year(o_orderdate) AS INTEGER) AS approval_year,
        o_totalprice AS valuation, o_orderpriority = '1-URGENT' AS is_solar FROM orders""",
    "map_points_sample": f"""SELECT event_id AS point_id, {point('event_id', 'user_id')},
        event_type AS service_name, CAST(year(ts) AS INTEGER) AS request_year FROM events
        ORDER BY CAST(event_id AS BIGINT) * 40503 % 2147483647, event_id LIMIT 1000""",
    "map_points_place": f"""SELECT p.* FROM (SELECT event_id AS point_id, {point('event_id', 'user_id')},
        event_type AS service_name, CAST(year(ts) AS INTEGER) AS request_year FROM events) p,
        (SELECT lat, lng FROM t_cent WHERE zip_code = '7') c
        WHERE p.lat >= c.lat - 0.05e0 AND p.lat <= c.lat + 0.05e0
          AND p.lng >= c.lng - 0.05e0 AND p.lng <= c.lng + 0.05e0""",
    "map_points_place_stored": f"""SELECT p.* FROM (SELECT event_id AS point_id, {point('event_id', 'user_id')},
        event_type AS service_name, CAST(year(ts) AS INTEGER) AS request_year FROM events) p,
        (SELECT lat, lng FROM t_cent WHERE zip_code = '7') c
        WHERE p.lat >= c.lat - 0.05e0 AND p.lat <= c.lat + 0.05e0
          AND p.lng >= c.lng - 0.05e0 AND p.lng <= c.lng + 0.05e0""",
    "point_classes": """SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'solar' ELSE 'other' END AS point_class,
        CAST(year(o_orderdate) AS INTEGER) AS approval_year, COUNT(*) AS points FROM orders GROUP BY ALL""",
    "nearby_places": "SELECT * FROM t_near",
    "nearby_display": f"""SELECT n.* EXCLUDE (v, city), zip_code = '7' AS is_selected,
        CAST(greatest(200, least(1500, active_count * 30)) AS INTEGER) AS radius,
        COALESCE(CASE WHEN per_1k <> 0 AND city > 0 THEN CASE WHEN v >= 0 THEN '+' ELSE '-' END
            || {fixed_text('ABS(v)')} || '%' END, '—') AS vs_city_avg
        FROM (SELECT *, (per_1k / NULLIF(city, 0) - 1) * 100 AS v FROM t_near,
              (SELECT MAX(city_avg_density) AS city FROM t_density WHERE category = 'restaurant')) n""",
    "nearby_all_centres": """SELECT category, zip_code, CAST(n AS INTEGER) AS position, near_key, active_count FROM (
        SELECT a.category, a.zip_code, b.zip_code AS near_key, b.active_count,
          ROW_NUMBER() OVER (PARTITION BY a.category, a.zip_code ORDER BY b.active_count DESC, b.zip_code) AS n
        FROM (SELECT r.*, lat, lng FROM t_rates r JOIN t_cent USING (zip_code) WHERE active_count > 0) a
        JOIN (SELECT r.*, lat, lng FROM t_rates r JOIN t_cent USING (zip_code) WHERE active_count > 0) b
          ON a.category = b.category AND ABS(b.lat - a.lat) <= CAST(0.1 AS DOUBLE)
         AND ABS(b.lng - a.lng) <= CAST(0.1 AS DOUBLE)) WHERE n <= 20""",
    "hex_density": hexagon(),
    "grid_density": f"""SELECT crime_against, CAST(floor(lat / 0.01e0) AS BIGINT) AS cell_row,
        CAST(floor(lng / 0.01e0) AS BIGINT) AS cell_col, COUNT(*) AS points
        FROM (SELECT {KIND} AS crime_against, {point('l_orderkey', 'l_partkey')} FROM lineitem) GROUP BY ALL""",
    "area_view_box": """SELECT area, ROUND(COALESCE(AVG(lat), 32.7157e0), 6) AS center_lat,
        ROUND(COALESCE(AVG(lng), -117.1611e0), 6) AS center_lng,
        ROUND(COALESCE(greatest(MAX(lat) - MIN(lat), MAX(lng) - MIN(lng)) / 2 + 0.02e0, 0.08e0), 6) AS half_deg
        FROM t_map LEFT JOIN t_cent USING (zip_code) GROUP BY area""",
    "competitors": """SELECT account_id, business_name, address, zip_code, start_date, status FROM t_biz
        WHERE category = 'restaurant' AND zip_code = '7' AND status = 'active'""",
    "competitor_density": "SELECT * FROM t_density",
    "businesses_lookup": """SELECT * FROM t_biz WHERE category = 'restaurant' AND status = 'inactive'""",
    "businesses_head": """SELECT * FROM t_biz ORDER BY business_name NULLS FIRST, account_id NULLS FIRST LIMIT 20000""",
    "service_types": """SELECT event_type AS service_name, COUNT(*) AS total_requests,
        COUNT(*) FILTER (WHERE value > 20) AS closed_requests,
        ROUND(AVG(CAST(floor(value) AS INTEGER)), 1) AS avg_resolution_days,
        ROUND(MEDIAN(CAST(floor(value) AS INTEGER)), 1) AS median_resolution_days,
        ROUND(1e2 * COUNT(*) FILTER (WHERE value > 20) / COUNT(*), 1) AS close_rate_pct FROM events GROUP BY event_type""",
    "crime_detail": """SELECT offense_group, crime_against, CAST(SUM(count) AS BIGINT) AS count FROM t_detail
        WHERE year = (SELECT MAX(year) FROM t_detail) GROUP BY ALL""",
    "crime_temporal": """SELECT dow, month, crime_against, CAST(SUM(count) AS BIGINT) AS count FROM t_temporal
        WHERE year = 2000 GROUP BY ALL""",
    "dow_month_grid": "SELECT d.dow, "
    + ", ".join(
        f"CAST(COALESCE(SUM(count) FILTER (WHERE month = {m}), 0) AS BIGINT) AS m{m:02d}" for m in range(1, 13)
    )
    + """ FROM (SELECT CAST(range AS INTEGER) AS dow FROM range(7)) d
        LEFT JOIN (SELECT * FROM t_temporal WHERE year = (SELECT MAX(year) FROM t_temporal)) t ON t.dow = d.dow
        GROUP BY d.dow""",
    "latest_breakdown": "SELECT * FROM t_latest_crime",
    "area_latest_breakdown": """SELECT area, crime_against, CAST(SUM(count) AS BIGINT) AS count
        FROM t_crime JOIN t_map USING (zip_code) WHERE year = (SELECT MAX(year) FROM t_crime) GROUP BY ALL""",
    "permit_timelines": f"""SELECT zip_code, year, permit_type, permit_count, median_days, CAST(n AS INTEGER) AS position
        FROM (SELECT zip_code, year, approval_type_clean AS permit_type, permit_count, ROUND(median_days, 0) AS median_days,
              ROW_NUMBER() OVER (PARTITION BY zip_code ORDER BY permit_count DESC, approval_type_clean) AS n
              FROM {LATEST_TIMELINES}) WHERE n <= 3""",
    "area_permit_timelines": """SELECT area, permit_type, permit_count, median_days, CAST(n AS INTEGER) AS position
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY area ORDER BY permit_count DESC, permit_type) AS n
              FROM (SELECT area, approval_type_clean AS permit_type, CAST(SUM(permit_count) AS BIGINT) AS permit_count,
                    ROUND(AVG(median_days), 0) AS median_days FROM t_timelines JOIN t_map USING (zip_code)
                    WHERE year = (SELECT MAX(year) FROM t_timelines WHERE permit_count > 0) AND permit_count > 0
                    GROUP BY ALL)) WHERE n <= 3""",
    "energy_benchmark": """SELECT zip_code, year, ROUND(avg_kwh_per_customer, 6) AS avg_kwh_per_customer, total_kwh,
        elec_customers FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY zip_code ORDER BY year DESC) AS n FROM t_energy)
        WHERE n = 1""",
    "area_energy": """SELECT area, ROUND(AVG(avg_kwh_per_customer), 0) AS avg_kwh_per_customer,
        CAST(SUM(total_kwh) AS BIGINT) AS total_kwh, CAST(SUM(elec_customers) AS BIGINT) AS elec_customers
        FROM t_energy JOIN t_map USING (zip_code) WHERE year = (SELECT MAX(year) FROM t_energy) GROUP BY area""",
    "areas": "SELECT area, zip_count, population, active_count, businesses_per_1k, median_income FROM t_area",
    "area_zips": """SELECT area, zip_code, neighborhood, population, active_count, businesses_per_1k, median_income,
        crime_count, new_permits FROM t_profile""",
    "place_options": "SELECT zip_code, neighborhood FROM t_profile",
    "vs_average": versus("t_vs", "zip_code"),
    "area_vs_average": versus("t_area_vs", "area"),
    "delta_text": """SELECT zip_code, CASE WHEN v >= 0 THEN '+' ELSE '-' END || '$'
        || format('{:,}', CAST(format('{:.0f}', ABS(v)) AS BIGINT)) || ' vs avg' AS income_delta
        FROM (SELECT zip_code, CAST(median_income AS DOUBLE) - avg_median_income AS v FROM t_profile, t_avg)""",
    "value_text": """SELECT zip_code, COALESCE(format('{:,}', population), '—') AS population,
        COALESCE('$' || format('{:,}', median_income), '—') AS median_income,
        COALESCE(format('{:.1f}', pct_bachelors_plus), '—') AS pct_bachelors_plus FROM t_demo""",
    "head_to_head": "SELECT * FROM t_h2h",
    "area_head_to_head": "SELECT area_a, area_b, metric, value_a, value_b, "
    + py("1e2 * (value_a - value_b) / NULLIF(ABS(value_b), 0)")
    + " AS difference FROM ("
    + " UNION ALL ".join(
        f"""SELECT area_a, area_b, '{m}' AS metric, {py('a.' + m)} AS value_a, {py('b.' + m)} AS value_b
        FROM t_area_pairs JOIN t_area a ON a.area = area_a JOIN t_area b ON b.area = area_b"""
        for m in fixed.AREA_COMPARISON
    )
    + ")",
    "winner_flags": f"""SELECT zip_code_a, zip_code_b, metric, CASE
        WHEN value_a IS NULL OR value_b IS NULL OR value_a = value_b THEN ''
        WHEN metric IN ({metric_names(fixed.COMPARISON_SENSE, 'neutral')}) THEN ''
        WHEN (value_a > value_b) = (metric IN ({metric_names(fixed.COMPARISON_SENSE, 'good')})) THEN 'a' ELSE 'b' END
        AS winner FROM t_h2h""",
    "category_merge": """SELECT category, COALESCE(a.active_count, 0) AS count_a, COALESCE(b.active_count, 0) AS count_b
        FROM (SELECT * FROM t_top_cat WHERE zip_code = '7') a
        FULL OUTER JOIN (SELECT * FROM t_top_cat WHERE zip_code = '8') b USING (category)
        ORDER BY COALESCE(a.active_count, 0) + COALESCE(b.active_count, 0) DESC, category NULLS FIRST LIMIT 15""",
    "maturity_bucket": """SELECT zip_code, category, median_age_years, CASE WHEN median_age_years < 2 THEN 'emerging'
        WHEN median_age_years < 5 THEN 'growing' WHEN median_age_years < 8 THEN 'maturing' ELSE 'established' END AS maturity
        FROM t_age_zip""",
    "rank_badges": f"""SELECT zip_code, metric, CASE
        WHEN metric IN ({metric_names(fixed.RANK_SENSE, 'low')}) THEN rank || CASE WHEN rank % 100 BETWEEN 11 AND 13 THEN 'th'
            WHEN rank % 10 = 1 THEN 'st' WHEN rank % 10 = 2 THEN 'nd' WHEN rank % 10 = 3 THEN 'rd' ELSE 'th' END
            || ' lowest of ' || of
        WHEN metric IN ({metric_names(fixed.RANK_SENSE, 'high')}) AND top <= 50
            THEN 'top ' || top || '% · rank ' || rank || ' of ' || of
        ELSE 'rank ' || rank || ' of ' || of END AS badge
        FROM (SELECT *, greatest(1, CAST({py('1e2 * rank / of', 0)} AS INTEGER)) AS top FROM t_pct)""",
    "narrative": place_narrative(),
    "comparison_narrative": pair_narrative(),
    "area_narrative": area_narrative(),
    "area_comparison_narrative": area_pair_narrative(),
    "incremental_load": "SELECT * FROM orders",
    "stored_job_graph": "SELECT * FROM t_area",
    "business_cube": "SELECT zip_code, category, status, start_date, COUNT(*) AS n FROM t_biz GROUP BY ALL",
    "formation_from_cube": "SELECT * FROM t_formation",
}
BODY["cube_extended"] = BODY["business_cube"]
BODY["crime_detail_stored"], BODY["crime_temporal_stored"] = BODY["crime_detail"], BODY["crime_temporal"]
BODY["service_types_top"] = BODY["service_types"] + " ORDER BY total_requests DESC, service_name LIMIT 15"
BODY["dataset_rows"] = " UNION ALL ".join(
    f"SELECT '{name}' AS dataset, true AS available, COUNT(*) AS row_count, {newest} AS newest FROM {name}"
    for name, newest in {
        **dict.fromkeys(["region", "nation", "customer", "supplier", "part"], "CAST(NULL AS DATE)"),
        "orders": "CAST(MAX(o_orderdate) AS DATE)", "lineitem": "CAST(MAX(l_shipdate) AS DATE)", "events": "CAST(MAX(ts) AS DATE)",
        **dict.fromkeys(["documents", "embeddings", "pages", "benchmark", "labels", "conversations"], "CAST(NULL AS DATE)"),
    }.items()
) + " UNION ALL SELECT 'homelessness', false, 0, NULL"
# Sections of the nested profiles hold what the flat queries give.
BODY["profile_percentiles"] = "SELECT zip_code, metric, rank, of, percentile FROM t_pct"
for section, flat in {"comparisons": "vs_average", "narratives": "narrative", "top_categories": "top_categories"}.items():
    BODY[f"profile_{section}"] = BODY[flat]
    BODY[f"area_profile_{section}"] = BODY[f"area_{flat}"]



def section_ranked(key: str, rows: str, order: str, fields: str, n: int) -> str:
    """The first n rows of a key with their position, as an array section lists them."""
    return f"""SELECT {key}, CAST(n AS INTEGER) AS position, {fields} FROM (SELECT *, ROW_NUMBER() OVER (
        PARTITION BY {key} ORDER BY {order}) AS n FROM ({rows}) r) WHERE n <= {n}"""


FIGURES = {name: py(name) for name in ["median_age", "pct_bachelors_plus", "businesses_per_1k", "permit_valuation", "median_311_days"]}
COUNTED = ["population", "active_count", "total_count", "new_permits", "solar_installs", "crime_count", "total_311_requests"]
MONEY = ["median_income", "median_home_value", "median_rent"]
for prefix, key, table in [("profile", "zip_code", "t_profile"), ("area_profile", "area", "t_area")]:
    flat = "" if prefix == "profile" else "area_"
    BODY[f"{prefix}_crime"] = section_ranked(key, BODY[f"{flat}latest_breakdown"], "count DESC, crime_against", "crime_against, count", 1000)
    BODY[f"{prefix}_permit_timelines"] = f"SELECT {key}, position, permit_type, permit_count, median_days FROM ({BODY[f'{flat}permit_timelines']})"
    BODY[f"{prefix}_ages"] = section_ranked(
        key, "SELECT * FROM " + ("t_age_zip" if prefix == "profile" else "t_age_area"), "business_count DESC, category NULLS FIRST", AGES, 5)
    BODY[f"{prefix}_energy"] = f"SELECT {key}, {py('avg_kwh_per_customer')} AS avg_kwh_per_customer, total_kwh, elec_customers FROM (" + (
        BODY["energy_benchmark"] if prefix == "profile" else BODY["area_energy"]) + ")"
    BODY[f"{prefix}_momentum"] = f"SELECT {key}, " + ", ".join(
        f"{py(c)} AS {c}" for c in ["momentum_score", "biz_formation_yoy", "permit_yoy", "crime_yoy", "solar_yoy"]
    ) + " FROM " + ("t_momentum WHERE zip_code IN (SELECT zip_code FROM t_names)" if prefix == "profile" else "t_mom_area")
    shaped = [f"{value} AS {name}" for name, value in FIGURES.items()]
    shaped += MONEY if prefix == "profile" else [f"{py(c)} AS {c}" for c in MONEY]
    BODY[f"{prefix}_figures"] = f"SELECT {', '.join([key, *COUNTED, *shaped, *(['category_count'] if prefix == 'profile' else [])])} FROM {table}"
BODY["text_files_union"] = """SELECT CASE WHEN o_orderkey % 10 = 3 THEN 'no. ' ELSE ' ' END || o_orderkey AS code,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status FROM orders"""
BODY["key_range_rows"] = f"SELECT * FROM ({BODY['text_files_union']}) WHERE TRY_CAST(trim(code) AS INTEGER) BETWEEN 100 AND 9000"
BODY["lookup_rows"] = """SELECT o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS status_name,
    COUNT(*) AS orders FROM orders GROUP BY 1, 2"""
BODY["rows_written"] = " UNION ALL ".join(
    f"SELECT '{name}' AS dataset, COUNT(*) AS written, COUNT(*) AS read_back FROM {name}" for name in ["orders", "lineitem", "events"]
)
BODY["metrics_allowed"] = " UNION ALL ".join(
    [f"SELECT '{name}' AS metric, COUNT({name}) AS known FROM t_profile" for name in ["population", "crime_count", "permit_valuation"]]
    + [f"SELECT '{name}' AS metric, CAST(NULL AS BIGINT) AS known" for name in ["neighborhood", "population; DROP TABLE x"]]
)
BODY["profile_figures_bucketed"], BODY["profile_top_categories_bucketed"] = BODY["profile_figures"], BODY["profile_top_categories"]

ORACLE = {name: with_tables(body) for name, body in BODY.items()}
