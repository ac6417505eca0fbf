"""DataFrame operators: dedup, locations, collection, quality and upsert."""
