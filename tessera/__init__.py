"""A PySpark-native query engine: a small strict SQL dialect and a DataFrame operator API over Catalyst."""
