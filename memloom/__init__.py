"""A PySpark-native engine for event-sourced memory analytics and training-data preparation."""
