"""A Spark-native engine for equity-market data lakes."""
