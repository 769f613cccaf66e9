"""Analytics over append-only knowledge logs on Spark."""
