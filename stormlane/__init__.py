"""Spark jobs over road-detector readings, rainfall and warning signals."""
