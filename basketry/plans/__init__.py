"""Compositions of operators over the fixture tables, and the query registry."""
