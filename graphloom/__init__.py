"""A PySpark-native analytics engine for weighted, time-stamped knowledge graphs."""
