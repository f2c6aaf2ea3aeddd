"""Factloom: evidence analytics over document collections, as Spark DataFrame transformations."""
