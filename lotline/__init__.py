"""Warehouse and delivery reports as PySpark DataFrame functions."""
