"""Part of the textloom engine: sources."""
