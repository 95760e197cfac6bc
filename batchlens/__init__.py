"""batchlens: batch-operations analytics as PySpark DataFrame operators."""
