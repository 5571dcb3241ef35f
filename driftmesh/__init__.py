"""Particles, meshes and graphs as Spark DataFrames."""
