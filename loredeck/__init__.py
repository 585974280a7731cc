"""loredeck: knowledge-base search, text preparation and operations analytics as Spark jobs."""
