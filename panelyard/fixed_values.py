"""Word lists, lookup tables, thresholds and patterns.

These must have exactly these values for results to agree with existing
outputs; every operator takes them as defaults of a parameter.
"""

# --- study area and incident layout -------------------------------------------------
TARGET_COUNTIES = ["Nairobi", "Kiambu", "Machakos", "Turkana"]

COUNTY_CODES = {"Nairobi": "NBI", "Kiambu": "KBU", "Machakos": "MCK", "Turkana": "TRK"}
UNKNOWN_COUNTY_CODE = "UNK"

NAME_ALIASES = {
    "langata": "lang'ata",
    "kiambu west": "kiambu",
}

INCIDENT_FIELDS = [
    "Record_ID", "Original_Record_ID", "County", "Sub_Location", "Date_Start",
    "Date_End", "Incident_Summary", "Conflict_Type", "Conflict_Subtype",
    "Parties_Involved", "Full_Text_Description", "Source_Name", "Source_URL",
    "Data_Source_Type", "Latitude", "Longitude", "Casualties_Reported",
    "Displaced_Persons", "Legal_Status", "Outcome_Status", "NLP_Keywords",
    "Verified", "Confidence_Score", "Notes",
]

MOJIBAKE_COLUMNS = [
    "Full_Text_Description", "Incident_Summary", "Notes",
    "Parties_Involved", "NLP_Keywords", "Source_Name",
]

SEARCH_COLUMNS = ["Record_ID", "Sub_Location", "Incident_Summary", "Full_Text_Description", "NLP_Keywords"]

# --- cleaning -----------------------------------------------------------------------
LONG_DURATION_DAYS = 180
CHRONIC_WORDS = r"composite|chronic|long[- ]running|long[- ]term|multiple sources|ongoing|sustained"

# --- decay features -----------------------------------------------------------------
HALF_LIFE_DAYS = 180
COMPOSITE_MULTIPLIER = 3.0
HALF_LIVES_DAYS = [90, 180, 365]

# --- land and water terms (list order decides which of two overlapping terms wins) -----
LAND_TERMS = [
    "title deed", "title deeds", "eviction", "displacement", "private land",
    "compulsory acquisition", "land use", "land right", "land rights",
    "boundary", "parcel", "landbuying", "land-buying", "land buying",
    "forest excision", "buffer zone", "grazing", "pasture", "communal land",
    "grabbing", "land grabbing", "registry", "easement", "compensation",
    "resettlement", "informal settlement",
]
WATER_TERMS = [
    "river", "water", "wetland", "stream", "irrigation", "riparian",
    "catchment", "dam", "water pan", "pipeline", "lake", "drought",
    "fishing", "borehole", "aquifer", "spring", "flood", "rainfall",
    "abstraction", "reservoir", "swamp", "water pollution",
]

# --- gazetteer ----------------------------------------------------------------------
RIVERS = [
    "Nairobi River", "Ngong River", "Mathare River", "Athi River",
    "Tana River", "Turkwel River", "Kerio River", "Nzoia River",
    "Omo River", "Ruiru River", "Chania River", "Thiba River",
    "Gatharaini River", "Riara River",
]
WATER_INFRASTRUCTURE = [
    "borehole", "boreholes", "dam", "reservoir", "water pan",
    "irrigation scheme", "water pipeline", "abstraction point",
    "water tower", "canal", "sewerage", "treatment plant",
]
COMMUNITIES = [
    "Dassanech", "Turkana community", "Maasai", "Kamba", "Kikuyu",
    "Pokot", "Samburu", "Merille", "pastoralist", "pastoralists",
    "agropastoralist", "smallholder farmers",
]
INSTITUTIONS = [
    "Water Resources Authority", "WRA", "WRUA", "NEMA",
    "National Environment Management Authority",
    "Water Resource Management Authority", "WRMA",
    "Kenya Alliance of Resident Associations", "KARA",
    "National Land Commission", "NLC", "Law Society of Kenya",
    "Githunguri Water and Sanitation Company", "GIWASCO",
]

# --- stop words ---------------------------------------------------------------------
DOMAIN_STOPWORDS = [
    "county", "kenya", "kenyan", "area", "region", "report", "reported",
    "according", "said", "stated",
]
WORD_CLOUD_STOPWORDS = [
    "the", "and", "for", "that", "this", "with", "from", "were", "have",
    "has", "had", "was", "are", "been", "being", "their", "they", "them",
    "which", "when", "while", "into", "over", "under", "after", "before",
    "county", "kenya", "kenyan", "area", "region", "report", "reported",
    "according", "said", "stated", "also", "would", "could", "should",
    "documented", "confirmed", "between", "during", "since", "such",
]
OTHER_PLACES = [
    "pokot", "west pokot", "baringo", "samburu", "marakwet",
    "elgeyo marakwet", "laikipia", "marsabit", "isiolo", "nakuru",
    "uganda", "ethiopia", "tiaty", "kerio", "kerio valley",
    "north rift", "kajiado", "kitui", "makueni",
]
GEOGRAPHY_WORDS = [
    "county", "counties", "sub-county", "subcounty", "sub county",
    "kenya", "kenyan", "ward", "village", "area", "region", "district",
]

# --- tone ---------------------------------------------------------------------------
POSITIVE_FROM = 0.05
NEGATIVE_TO = -0.05

# --- candidate collection -----------------------------------------------------------
SCOPE_KEYWORDS = [
    "land dispute", "water conflict", "riparian encroachment", "eviction",
    "land grabbing", "water access dispute", "pastoralist conflict",
    "cattle raid", "grazing rights dispute", "water abstraction dispute",
    "boundary dispute", "informal settlement demolition",
]
SOURCE_TYPES = {
    "kenyalaw.org": "Court Record",
    "nation.africa": "Print/Online News",
    "standardmedia.co.ke": "Print/Online News",
    "the-star.co.ke": "Print/Online News",
    "businessdailyafrica.com": "Print/Online News",
    "capitalfm.co.ke": "Print/Online News",
    "nema.go.ke": "Government",
    "wra.go.ke": "Government",
    "water.go.ke": "Government",
    "knchr.org": "NGO",
    "hrw.org": "NGO",
    "amnesty.org": "NGO",
    "acleddata.com": "Conflict Data",
}
DEFAULT_SOURCE_TYPE = "Print/Online News"

CASUALTY_SENTENCE = (
    r"([^.]*\b(\d+|dozens?|scores?|several|many)\b[^.]*"
    r"\b(died|killed|dead|casualt\w+|injured|wounded)\b[^.]*\.)"
)
DISPLACEMENT_SENTENCE = (
    r"([^.]*\b(\d+|dozens?|scores?|several|many|hundreds?|thousands?)\b[^.]*"
    r"\b(displaced|fled|evacuat\w+|homeless)\b[^.]*\.)"
)
LOWER_BOUND_PHRASE = r"\bat least\b|\bmore than\b|\bover\b"
SUGGESTED_FIELDS = ["Sub_Location", "Date_Start", "Parties_Involved", "Casualties_Reported", "Displaced_Persons"]
DRAFT_TEXT_LIMIT = 5000
DRAFT_NOTE = (
    "AUTO-SUGGESTED, NOT VERIFIED. Read Source_URL and confirm every field, "
    "especially Sub_Location, Date_Start, Casualties_Reported, and "
    "Displaced_Persons, before setting Verified=True. Conflict_Type, "
    "Conflict_Subtype, Legal_Status, and Outcome_Status were left blank "
    "deliberately -- fill these in after reading the source."
)

# --- similarity thresholds ----------------------------------------------------------
NAME_SCORE_CUTOFF = 80.0
NEAR_DUPLICATE_SCORE = 80.0
NEAR_DUPLICATE_GAP_DAYS = 30
INTAKE_JACCARD = 0.30
INTAKE_WINDOW_DAYS = 30

# --- modelling ----------------------------------------------------------------------
DYNAMIC_FEATURES = [
    "conflict_persistence", "conflict_severity_weighted",
    "decayed_sentiment", "topic_diversity",
    "Mean_NDVI", "Rainfall_mm", "Rainfall_Anomaly_mm", "Rainfall_Anomaly_Percent",
]
STATIC_FEATURES = [
    "Population_Density_per_SqKm", "Total_Population",
    "total_abstraction_m3_per_day", "wrua_count",
]
TARGET = "conflict_onset"
HORIZONS_MONTHS = [3, 6, 9, 12, 15, 18, 21, 24]
CUTOFF_YEAR = 2022
LOGISTIC_GRID = {"C": [0.01, 0.1, 1.0, 10.0], "balanced": [False, True]}
FOREST_GRID = {
    "trees": [200, 400], "depth": [5, 10, None], "leaf": [1, 5], "balanced": [False, True],
}
BOOSTING_CHOICES = {
    "rounds": [100, 200, 300, 400, 500],
    "depth": [3, 4, 5, 6, 7, 8],
    "rate": [0.01, 0.03, 0.05, 0.1, 0.15, 0.2],
    "row_share": [0.6, 0.7, 0.8, 0.9, 1.0],
    "column_share": [0.6, 0.7, 0.8, 0.9, 1.0],
    "leaf": [1, 3, 5, 7],
}
BOOSTING_DRAWS = 40

# --- maps and charts ----------------------------------------------------------------
CLUSTER_EPS_KM = 25.0
CLUSTER_MIN_POINTS = 3
UTM_ZONE = 37
