"""Operators on location tables, pages and text."""
