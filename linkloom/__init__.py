"""linkloom: a Spark-native entity-resolution engine for Thai and English names."""
