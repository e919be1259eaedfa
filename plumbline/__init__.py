"""Plumbline: software-governance analytics as plain Spark DataFrame operators."""
