"""Data quality for conversation transcripts, as Spark DataFrame operations."""
