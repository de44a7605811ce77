"""A PySpark-native analytics engine for technical documents."""
