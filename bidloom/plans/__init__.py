"""Procurement stages: each one a chain of DataFrame transforms plus roll-ups."""
