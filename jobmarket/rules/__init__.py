"""Rule tables that fix the meaning of the standardized columns."""
