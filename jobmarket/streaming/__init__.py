"""Incremental import of landed postings."""
