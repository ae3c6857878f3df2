"""Waymark: directory analytics on PySpark."""
