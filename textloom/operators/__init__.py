"""Part of the textloom engine: operators."""
