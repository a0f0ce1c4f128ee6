"""Readers for log files, indicator feeds and packet tables."""
