"""Schemas, scans, sinks, generators and derived views."""
