"""Ranked retrieval with data-driven cut-offs, its evaluation and its benchmark builders, as Spark jobs."""
