"""Scans of landed bytes: feeds, sitemaps, robots files, pages; views of the test tables."""
