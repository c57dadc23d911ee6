"""Field-level lineage analytics and data preparation as Spark DataFrame jobs."""
