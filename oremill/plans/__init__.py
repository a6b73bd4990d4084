"""Helpers that shape physical plans: staged tables and hot-key handling."""
