"""souklens: marketplace analytics as Spark DataFrame jobs."""
