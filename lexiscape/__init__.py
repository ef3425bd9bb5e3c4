"""Lexiscape: a Spark engine that turns a text collection into a queryable map."""
