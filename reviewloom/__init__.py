"""Review-text analytics as Spark DataFrame, SQL and Spark ML jobs."""
