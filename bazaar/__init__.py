"""Retail analytics jobs on Spark: raw messages to clean tables, one wide sales fact, reports, features, models."""
