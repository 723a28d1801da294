"""Text-compression analytics on PySpark: symbols, models, code lengths, reports."""
