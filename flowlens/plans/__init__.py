"""The queries of each topic, with their equivalents in SQL."""
