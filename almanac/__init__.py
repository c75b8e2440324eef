"""almanac: a PySpark-native engine for time-stamped listings and text corpora."""
