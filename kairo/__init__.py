"""kairo: a Spark-native engine for ordered, schema-typed time series."""
