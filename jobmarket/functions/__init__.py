"""Column functions: text, salary, industry, title and HTML building blocks."""
