"""Whole detection plans and the registered queries with their reference SQL."""
