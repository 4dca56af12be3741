"""Requirement, usage and code-base analytics as Spark plans."""
