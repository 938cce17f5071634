"""sitelens: a PySpark-native engine for auditing and preparing web-page corpora."""
