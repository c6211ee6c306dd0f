"""tidemill: a PySpark-native engine for building language-model training corpora."""
