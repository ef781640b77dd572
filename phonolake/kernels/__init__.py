"""Numerics of one recording, in numpy alone. Nothing here knows Spark."""
