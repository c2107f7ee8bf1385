"""Compositions: the query catalogue on the driver tables and the clinical
compositions on hospital-shaped tables."""
