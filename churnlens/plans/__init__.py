"""Composed jobs (C*) and the registered query catalog."""
