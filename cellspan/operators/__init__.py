"""Relational operators over balls, surfaces, hierarchies, frames and graphs."""
