"""Column helpers: money, text, dates and recurrence rules."""
