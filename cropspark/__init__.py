"""Spark-native analytics for agricultural, climate and wholesale-price open data."""
