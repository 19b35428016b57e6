"""Readers: sensor logs, event streams as samples, JSON results and labelled windows."""
