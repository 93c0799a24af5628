"""Spark jobs for comparing observations across sources, periods and areas."""
