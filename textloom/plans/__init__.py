"""Part of the textloom engine: plans."""
