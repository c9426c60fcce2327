"""Filtered nearest-neighbour analytics as plain PySpark DataFrame functions."""
