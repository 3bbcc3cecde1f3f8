"""Part of the textloom engine: streaming."""
