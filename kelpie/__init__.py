"""Spark-native analytics over the records that a columnar read cache leaves behind."""
