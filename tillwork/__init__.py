"""Analytics for an online shop, written as Spark jobs."""
