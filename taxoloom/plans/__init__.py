"""Registered queries and their SQL oracles."""
