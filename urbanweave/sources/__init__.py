"""Readers and sinks for landed months, serving tables and reports."""
