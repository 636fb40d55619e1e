"""Operators for preparing large text corpora (tokenising, de-duplication, filtering, mixing)."""
