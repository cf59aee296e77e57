"""vayuspark: hourly air-quality analytics written as Spark DataFrame jobs."""
