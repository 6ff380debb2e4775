"""Query-suggestion and trending analytics as Spark jobs."""
