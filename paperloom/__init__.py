"""A Spark-native engine for coding documents into checked, traceable data sets."""
