"""Sensor-log and training-data analytics as composable Spark DataFrame operators."""
