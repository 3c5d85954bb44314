"""psephos: a PySpark-native engine for multi-source election results and corpus tables."""
