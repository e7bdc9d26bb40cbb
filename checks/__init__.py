"""Registered queries, their fixtures and the reference SQL."""
