"""A PySpark-native engine for property-listing analytics and corpus preparation."""
