"""Rating analytics on Spark: ingest scores, keep the last one, report on them."""
