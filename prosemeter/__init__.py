"""prosemeter: a PySpark-native engine for measuring prose at corpus scale."""

__version__ = "0.1.0"
