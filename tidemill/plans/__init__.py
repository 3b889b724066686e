"""The registered queries with their SQL."""
