"""Plans over results: evaluation, tuning, fusion, serving policies, storage."""
