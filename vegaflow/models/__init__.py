"""Iterative models as small numpy functions that Spark runs per key."""
