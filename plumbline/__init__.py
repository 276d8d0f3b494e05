"""plumbline: a PySpark-native code-quality analytics engine."""
