"""Trailhound: security-log and packet analytics as Spark DataFrame operators."""
