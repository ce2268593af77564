"""Spark-native trajectory segmentation, compression and evaluation, with corpus operators in ``llm``."""
