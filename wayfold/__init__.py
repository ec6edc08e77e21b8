"""Wayfold: spatio-temporal co-presence analytics, expressed as Spark DataFrame transformations."""
