"""tessella: dialect-aware analytics and query equivalence on Spark."""
