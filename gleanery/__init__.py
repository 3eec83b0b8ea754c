"""Governed catalogue analytics as Spark DataFrame plans."""
