"""factloom: Spark-native reconciliation of facts stated across documents."""

__version__ = "0.1.0"
