"""Loomgraph: SPARQL-style graph analytics compiled to Spark DataFrames."""

__version__ = "0.1.0"
