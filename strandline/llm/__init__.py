"""Training-data operators: one module for each, with the query that applies it.

Nothing outside this folder imports it; the driver may delete it.
"""
