"""Larder: a Spark-native engine for a meal-planning catalogue."""
