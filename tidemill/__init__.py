"""A PySpark-native engine for operational records and documents."""
