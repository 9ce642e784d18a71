"""Column functions on text fields, dates, validation results and confidence scores."""
