"""Trailhead: program-graph analytics expressed as Spark DataFrame plans."""
