"""Compositions of operators: evaluation, generation, selection, reports, and the named queries."""
