"""Spark-native analytics over layered geographic evidence: grids, vectors, intervals, time cubes and rule tables."""
