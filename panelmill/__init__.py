"""Post labelling and author-panel building as Spark DataFrame jobs."""
