"""Operators put together: rule lists, analyses, versions, reports and summaries."""
