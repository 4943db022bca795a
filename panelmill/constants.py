"""Values that results depend on.

Fixed values: every name, number and lookup in this file is part of the data contract of the
tables this package reads and writes.  They are facts, not tuning knobs.
"""

# --- fixed values ------------------------------------------------------------------------

TABLE_PREFIX = "wh_panel_mapping_"
POST_TABLE = "ts_page_content"

# Production group -> sources ("video" belongs to no group).
PRODUCTION_GROUPS = {
    "fb": ["fbfans", "fbgroup", "fbkol", "fbpm", "fbprivategroup"],
    "forum": ["forum", "Dcard"],
    "bbs": ["Ptt"],
    "social": ["Instagram", "Tiktok", "Twitter", "plurk"],
    "comment": ["Comment"],
    "youtube": ["Youtube"],
    "news": ["news"],
    "Blog": ["blog"],
}

# Panels of one term exclude each other when an old and a new snapshot are merged.
CONFLICT_GROUPS = {
    "GENDER": ["/male", "/female"],
    "MARRIAGE": ["/unmarried", "/married"],
}

LABEL_NAMES = {
    "男性": "male",
    "女性": "female",
    "未婚": "unmarried",
    "已婚": "married",
    "孩子": "child",
    "有子女": "parenting",
    "青年": "young",
    "上班族": "employee",
    "學生": "student",
}

# Site ids of the sources with a handful of sites.  The long site lists (blog, forum, news) are
# data: read them with sources.rules.read_source_map.
SOURCE_SITES = {
    "Comment": ["WH_F0183", "WH_F0198", "WH_F0200", "WH_F0199", "WH_F0500"],
    "Instagram": ["WH_F0157"],
    "Ptt": ["WH_F0001"],
    "Tiktok": ["WH_F0501"],
    "Twitter": ["WH_F0127"],
    "Youtube": ["WH_F0147"],
    "fbfans": ["WH_F0045"],
    "fbgroup": ["WH_F0165"],
    "fbkol": ["WH_F0071"],
    "fbpm": ["WH_F0072"],
    "fbprivategroup": ["WH_F0167"],
    "plurk": ["WH_F0038"],
    "video": ["wh_v001"],
}

MATCH_TYPES = ["partially", "absolutely", "start", "end"]
MODEL_TYPES = ["keyword_model", "rule_model", "random_forest_model", "term_weight_model"]

SLICE_HOURS = 6            # length of one read slice
SAMPLE_SHARE = 0.2         # result sample: share of rows considered ...
SAMPLE_ROWS = 50           # ... and rows shown per source
RECENT_TASKS = 5           # length of the task list
TERM_THRESHOLD = 0.3       # mean term weight above which a label is given

FOREST_TREES = 100
FOREST_MAX_FEATURES, FOREST_MIN_DF = 5000, 2
TERM_MAX_FEATURES, TERM_MIN_DF = 10000, 50
TERM_L1_RATIO = 0.9

# --- end of fixed values -----------------------------------------------------------------
