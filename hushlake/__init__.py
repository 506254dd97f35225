"""PySpark-native search and analytics over sealed (encrypted) columns."""
