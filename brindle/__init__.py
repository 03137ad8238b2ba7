"""brindle: a PySpark-native engine for reaction and exposure logs."""

__version__ = "0.1.0"
