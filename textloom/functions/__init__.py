"""Part of the textloom engine: functions."""
