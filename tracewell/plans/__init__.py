"""From SQL text to flat relations, by Spark's own parser."""
