"""A PySpark-native engine for multidimensional analysis over star and snowflake schemas."""

__version__ = "0.1.0"
