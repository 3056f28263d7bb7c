"""Spark-native catalogs, crosswalks, fetch plans and harmonized time series for environmental monitoring data."""
