"""Fixed values of the note model: capacities, thresholds and weights."""

# Fixed values.
WARM_LIMIT = 3000
PRESSURE_WARN = 0.8
CONTEXT_BUDGET = 2000
PROFILE_BUDGET = 500
DEDUP = 0.9
MERGE = 0.95
REVIEW = 0.75
MID_HITS = 3
HIGH_HITS = 8
TAU_DAYS = 30.0
RETENTION_FLOOR = 0.2
CHARS_PER_TOKEN = 1.5
CONTEXT_RECALL = 20
EPISODIC_LIMIT = 20
EPISODIC_DAYS = 2
CLUSTER_MIN = 3
RANK = {"low": 0.3, "mid": 0.6, "high": 0.9}
WEIGHT = {"high": 3, "mid": 2, "low": 1}
LEVELS = ["low", "mid", "high"]
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
