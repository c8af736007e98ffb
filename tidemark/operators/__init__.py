"""Relational, statistical and ordered operators on frames."""
