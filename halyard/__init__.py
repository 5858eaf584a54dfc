"""Halyard: star-schema analytics and corpus preparation on Spark DataFrames."""
