"""Query streams: batches and caches."""
