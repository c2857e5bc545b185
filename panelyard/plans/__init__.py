"""Registered queries: each runs an operator over whole tables, most with an equal SQL text."""
