"""lodestack: a PySpark-native engine for labelled-data catalogs."""
