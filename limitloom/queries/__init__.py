"""Registered queries, grouped by the kind of operator they exercise."""
