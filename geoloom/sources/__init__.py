"""Readers: tables, URL lists, sitemaps, robots files, cached results."""
