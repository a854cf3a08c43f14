"""millrace: a Spark-native SQL engine over lakehouse tables."""
