"""Cell, spot and corpus analytics as Spark DataFrame jobs."""
