"""Spark DataFrame operators for dated, located incident records and area-by-month panels."""
