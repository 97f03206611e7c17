"""duoscope: Spark-native analysis of pairs of actors in event logs."""
