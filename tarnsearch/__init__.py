"""Spark-native hybrid document search: keyword, semantic and fused ranking over DataFrames."""
