"""Spark-native analytics for station-based mobility networks: trips, availability, space, forecasts, routes."""
