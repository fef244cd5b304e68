"""Column functions: text, paths, JSON, grading.  All built from Spark expressions."""
