"""Spark jobs that turn scanned hearing lists into clean, scored and de-duplicated case records."""
