"""Readers and writers, and the tables built from them."""
