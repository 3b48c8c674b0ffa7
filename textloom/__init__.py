"""Spark-native text analytics: segmentation, annotation, PII, retrieval, streaming."""
