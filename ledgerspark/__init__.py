"""Spend analytics and corpus preparation expressed as Spark DataFrame plans."""
