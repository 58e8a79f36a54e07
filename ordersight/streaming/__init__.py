"""Day-by-day processing with state kept in tables."""
