"""carepulse: Spark-native admissions and revenue analytics."""
