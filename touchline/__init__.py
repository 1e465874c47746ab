"""Marketing attribution and funnel analytics as Spark DataFrame jobs."""
