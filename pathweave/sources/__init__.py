"""Readers of decoded routing files, and their landing."""
