"""Event detection in short texts, on Spark."""
