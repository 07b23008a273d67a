"""Page-view analytics on Spark: ingest, event table, reports and series."""
