"""Spatio-temporal exposure analytics as composable Spark DataFrame operators."""
