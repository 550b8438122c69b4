"""Column functions: text, JSON values, personal data."""
