"""Statement ingestion, reconciliation and corpus operators as Spark jobs."""
