"""Cross-sectional signal research as Spark DataFrame jobs."""
