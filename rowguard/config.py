"""Column names and default thresholds shared by the jobs."""

ID = "id__cmd"
CITY = "city__cmd"
POST_CODE = "post_code__cmd"
LAT = "lat__cmd"
LONG = "long__cmd"
STANDARD = "standardized_city"
CLUSTER = "cluster"
COMMON_CLUSTER = "most_common_cluster"
CODE = "index"
SCORE_COORDS = "S_Score_coordinates"
SCORE_CITY = "S_Score_city"
SCORE_CITY_CLUSTER = "S_Score_city_cluster"

MANUAL = "to be manually selected"

FUZZY_THRESHOLD = 92.0
JARO_WINKLER_THRESHOLD = 85.0
TOP_K_COORDS = 5
TOP_K_CITY = 1000
SHARE_COORDS = 0.005
SHARE_CITY = 0.05
MIN_NEIGHBOURS = 5

FEATURES = [LAT, LONG, SCORE_COORDS, SCORE_CITY_CLUSTER, "neighbors_count"]
LABEL = "is_anomaly"

# The tags users filter on.
TAG_SPELLING = "case 1 - city to be standardized"
TAG_SPELLING_AND_PLACE = "case 2 - both city standardization and coords to be checked"
TAG_PLACE = "case 3 - inconsistency between city name and coords"
TAG_OUTLIER = "case 4 - out of Country"
