"""Content-catalogue queries, ingestion and data preparation on Spark."""
