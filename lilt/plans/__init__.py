"""End-to-end compositions, the analyzer registry and the query catalogue."""
