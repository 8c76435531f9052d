"""geolake: a PySpark-native geospatial lakehouse and geocoding engine."""
