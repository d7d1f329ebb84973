"""Columns, row operators, sources and plans of the assessment engine."""
