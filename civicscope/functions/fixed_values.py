"""Industry code tables, keyword lists, metric directions and labels.

They must be exactly these for classifications, ranks and sentences to agree with
published results.  Callers may pass their own tables instead.
"""

# Two-digit industry sector -> category.
SECTORS = {
    "11": "agriculture",
    "21": "mining & extraction",
    "22": "utilities",
    "23": "construction",
    "31": "manufacturing",
    "32": "manufacturing",
    "33": "manufacturing",
    "42": "wholesale trade",
    "44": "retail",
    "45": "retail",
    "48": "transportation",
    "49": "warehousing & logistics",
    "51": "information & media",
    "52": "finance & insurance",
    "53": "real estate",
    "54": "professional services",
    "55": "management of companies",
    "56": "administrative services",
    "61": "education",
    "62": "healthcare",
    "71": "arts & entertainment",
    "72": "food & accommodation",
    "81": "personal services",
    "92": "government",
}

# Industry code prefix of four to six digits -> category.
PREFIXES = {
    "7223": "food service contractor",
    "7224": "drinking places",
    "7225": "restaurant",
    "72251": "restaurant",
    "722511": "restaurant",
    "722513": "restaurant",
    "722514": "cafe & snack bar",
    "722515": "cafe & snack bar",
    "7221": "food & accommodation",
    "7211": "hotel & lodging",
    "72111": "hotel & lodging",
    "721110": "hotel & lodging",
    "72119": "hotel & lodging",
    "721191": "bed & breakfast",
    "4451": "grocery",
    "44511": "grocery",
    "4452": "specialty food store",
    "4453": "liquor store",
    "4461": "health & personal care",
    "4471": "gas station",
    "4481": "clothing store",
    "4511": "sporting goods",
    "4521": "department store",
    "4531": "florist",
    "4532": "office supply",
    "4533": "used merchandise",
    "4539": "pet store",
    "6211": "physician",
    "6212": "dentist",
    "6213": "healthcare practitioner",
    "6214": "outpatient care",
    "6215": "medical lab",
    "6216": "home health care",
    "6221": "hospital",
    "6231": "nursing care",
    "6241": "social services",
    "6244": "child care",
    "5411": "legal services",
    "5412": "accounting",
    "5413": "architecture & engineering",
    "5414": "graphic design",
    "5415": "technology services",
    "5416": "management consulting",
    "5417": "scientific research",
    "5418": "advertising & marketing",
    "8111": "auto repair",
    "8112": "electronics repair",
    "8113": "commercial repair",
    "8121": "personal care (salon/spa)",
    "8122": "funeral services",
    "8123": "laundry & dry cleaning",
    "8129": "pet care",
    "7111": "performing arts",
    "7112": "spectator sports",
    "7121": "museum",
    "7131": "amusement park",
    "7139": "recreation & fitness",
    "2361": "residential construction",
    "2362": "commercial construction",
    "2381": "building foundation",
    "2382": "building equipment",
    "2383": "building finishing",
    "2389": "specialty trade",
}

# Words searched in a description, in this order; first list to hit wins.
KEYWORDS = [
    (["restaurant", "dining", "eatery", "bistro", "grill", "taqueria", "sushi"], "restaurant"),
    (["coffee", "cafe", "espresso", "tea house"], "cafe & snack bar"),
    (["bar", "pub", "tavern", "brewery", "taproom", "lounge", "nightclub"], "drinking places"),
    (["pizza", "pizzeria"], "restaurant"),
    (["bakery", "donut", "bagel"], "cafe & snack bar"),
    (["salon", "barber", "spa", "beauty", "nail", "hair"], "personal care (salon/spa)"),
    (["gym", "fitness", "yoga", "pilates", "crossfit"], "recreation & fitness"),
    (["dentist", "dental"], "dentist"),
    (["doctor", "physician", "medical", "clinic", "chiropractic"], "physician"),
    (["lawyer", "attorney", "law office", "legal"], "legal services"),
    (["accounting", "accountant", "cpa", "bookkeeping", "tax prep"], "accounting"),
    (["real estate", "property management", "realty"], "real estate"),
    (["insurance"], "finance & insurance"),
    (["hotel", "motel", "inn", "resort", "hostel"], "hotel & lodging"),
    (["grocery", "market", "supermarket"], "grocery"),
    (["auto repair", "mechanic", "body shop", "oil change"], "auto repair"),
    (["daycare", "child care", "preschool"], "child care"),
    (["consulting"], "management consulting"),
    (["construction", "contractor", "plumbing", "electric", "roofing", "hvac"], "construction"),
    (["retail", "shop", "store", "boutique"], "retail"),
    (["tech", "software", "web develop", "it service", "app develop"], "technology services"),
]

# Metrics that get a percentile rank; True where the largest value is rank 1.
PERCENTILE_METRICS = {
    "population": True,
    "median_income": True,
    "median_age": True,
    "median_home_value": True,
    "median_rent": False,
    "pct_bachelors_plus": True,
    "active_count": True,
    "businesses_per_1k": True,
    "new_permits": True,
    "crime_count": False,
    "median_311_days": False,
    "solar_installs": True,
    "momentum_score": True,
}

# How a rank of each metric is worded.
RANK_SENSE = {
    "population": "high",
    "median_income": "high",
    "median_age": "neutral",
    "median_home_value": "neutral",
    "median_rent": "low",
    "pct_bachelors_plus": "high",
    "active_count": "high",
    "businesses_per_1k": "high",
    "new_permits": "high",
    "crime_count": "low",
    "median_311_days": "low",
    "solar_installs": "high",
    "momentum_score": "high",
}

# Metrics a ranking may sort by.
RANKING_METRICS = [
    "population",
    "median_income",
    "median_age",
    "median_rent",
    "median_home_value",
    "pct_bachelors_plus",
    "active_count",
    "businesses_per_1k",
    "category_count",
    "new_permits",
    "crime_count",
    "median_311_days",
    "solar_installs",
    "total_311_requests",
    "permit_valuation",
    "momentum_score",
]

# Profile metric -> column of the city averages it is compared with.
AVERAGE_OF = {
    "population": "avg_population",
    "median_income": "avg_median_income",
    "median_home_value": "avg_median_home_value",
    "median_rent": "avg_median_rent",
    "pct_bachelors_plus": "avg_pct_bachelors_plus",
    "active_count": "avg_active_businesses",
    "businesses_per_1k": "avg_businesses_per_1k",
}

# Metrics set side by side for two places, and for two areas.
PLACE_COMPARISON = [
    "population",
    "median_age",
    "median_income",
    "median_home_value",
    "median_rent",
    "pct_bachelors_plus",
    "active_count",
    "businesses_per_1k",
    "new_permits",
    "crime_count",
    "median_311_days",
    "solar_installs",
]
AREA_COMPARISON = [
    "population",
    "median_income",
    "median_home_value",
    "median_rent",
    "pct_bachelors_plus",
    "active_count",
    "businesses_per_1k",
    "new_permits",
    "crime_count",
    "solar_installs",
    "median_311_days",
]

# Whether a higher value wins, loses or says nothing in a comparison.
COMPARISON_SENSE = {
    "population": "good",
    "median_income": "good",
    "active_count": "good",
    "businesses_per_1k": "good",
    "pct_bachelors_plus": "good",
    "median_age": "neutral",
    "median_rent": "bad",
    "median_home_value": "neutral",
    "new_permits": "good",
    "crime_count": "bad",
    "median_311_days": "bad",
    "solar_installs": "good",
}

# Fixed values, sentence metrics: (metric, average, label, sense, word for less).
PLACE_SENTENCE = [
    ("population", "avg_population", "people", "good", "fewer"),
    ("median_income", "avg_median_income", "income", "good", "lower"),
    ("pct_bachelors_plus", "avg_pct_bachelors_plus", "college grads", "good", "fewer"),
    ("active_count", "avg_active_businesses", "businesses", "good", "fewer"),
    ("businesses_per_1k", "avg_businesses_per_1k", "businesses per capita", "good", "fewer"),
    ("crime_count", "avg_crime_count", "crime", "bad", "less"),
    ("median_311_days", "avg_median_311_days", "311 response time", "bad", "less"),
    ("new_permits", "avg_new_permits", "new permits", "good", "fewer"),
    ("median_rent", "avg_median_rent", "rent", "bad", "lower"),
]
AREA_SENTENCE = [
    ("active_count", "avg_active_businesses", "businesses", "good", "fewer"),
    ("businesses_per_1k", "avg_businesses_per_1k", "businesses per 1k residents", "good", "fewer"),
    ("median_income", "avg_median_income", "median income", "good", "lower"),
    ("median_rent", "avg_median_rent", "median rent", "bad", "lower"),
    ("median_home_value", "avg_median_home_value", "home values", "bad", "lower"),
    ("crime_count", "avg_crime_count", "crime incidents", "bad", "fewer"),
    ("new_permits", "avg_new_permits", "new permits", "good", "fewer"),
    ("solar_installs", "avg_solar_installs", "solar installs", "good", "fewer"),
    ("pct_bachelors_plus", "avg_pct_bachelors_plus", "college-educated residents", "good", "fewer"),
]
# Fixed values, sentence comparing two areas: (metric, label, sense).
AREA_PAIR_SENTENCE = [
    ("population", "population", "neutral"),
    ("median_income", "median income", "good"),
    ("businesses_per_1k", "businesses per capita", "good"),
    ("active_count", "total businesses", "good"),
    ("crime_count", "crime incidents", "bad"),
    ("new_permits", "new permits", "good"),
    ("median_311_days", "311 response time", "bad"),
]
