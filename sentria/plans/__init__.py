"""Whole plans: the derived views, the registered queries, the request protocol."""
