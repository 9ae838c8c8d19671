"""sparkquarry: repository and corpus analytics as Spark DataFrame jobs."""
