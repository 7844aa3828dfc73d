"""A Spark engine over an append-only, versioned, expiry-aware key-value log."""
