"""folioforge: document retrieval and its evaluation as Spark DataFrame jobs."""
