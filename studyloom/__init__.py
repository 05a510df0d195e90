"""Studyloom: learning-analytics computations as Spark DataFrame jobs."""
