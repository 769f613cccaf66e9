"""Schemas of the tables."""

OPLOG = (
    "seq long, lineage_id string, op string, id string, target string, new_id string, text string, carry boolean, hard boolean, to string, ts string, "
    "key string, kind string, entity string, source string, confidence string, created string, hits long, last_accessed string, extra string"
)
CLAIMS = "id string, text string, key string, kind string, entity string, source string, confidence string, created string, hits long, last_accessed string, status string, birth_seq long, lineage_id string"
EPISODIC = "id string, ts string, text string, topic string, entity string, ord long, month string"
VECTORS = "id string, model string, ord long, embedding array<float>, digest string"
AUDIT = "ts string, action string, detail string"
