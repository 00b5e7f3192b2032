"""millrace: a PySpark-native engine for building, curating and scoring code corpora."""
