"""Queries over the jobs table and the end-to-end run."""
