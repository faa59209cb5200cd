"""Column functions: text, dates, amounts and phone numbers."""
