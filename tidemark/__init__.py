"""A PySpark-native engine for calendar-aware time-series analytics."""
