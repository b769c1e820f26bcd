"""Spark-native site-index and crawl analytics: every operator maps DataFrames (or Columns) to DataFrames."""
