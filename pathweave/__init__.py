"""Routing-table reconstruction and analytics as Spark DataFrame plans."""
