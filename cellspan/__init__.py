"""Spark-native analytics of spatial partitions of weighted balls."""
