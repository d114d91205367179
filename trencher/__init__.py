"""Catalogue quality, browsing and entity resolution as Spark DataFrame jobs."""
