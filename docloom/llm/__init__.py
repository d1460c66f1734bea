"""Training-data operators: one module for each, and ``queries`` with the registered queries.

Nothing outside this subpackage imports it; the package works without it.
"""
