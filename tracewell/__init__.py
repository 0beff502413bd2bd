"""Column-lineage analytics expressed as Spark jobs."""
