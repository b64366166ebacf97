"""Relational facts and evidence graphs as Spark DataFrames."""
