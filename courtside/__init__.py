"""Sports results and prediction-market analytics, expressed as Spark jobs."""
