"""ampliq: PCR assay analytics expressed as Spark DataFrame jobs."""
