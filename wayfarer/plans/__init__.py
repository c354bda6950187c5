"""Composed plans: the star schema, the OLAP pack and the batch lifecycles."""
