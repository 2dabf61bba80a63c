"""strandlake: a PySpark-native sequence index engine."""
