"""Architecture-graph analytics expressed as PySpark DataFrame jobs."""
