"""kinmatch: Spark-native entity resolution and training-data operators."""
