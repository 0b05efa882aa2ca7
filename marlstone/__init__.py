"""A PySpark-native engine for annotating and scoring labelled media, and for preparing text corpora."""
