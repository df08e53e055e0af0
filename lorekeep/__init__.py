"""A PySpark-native engine for storing, searching and curating text memories."""
