"""Column expressions: text, urls, dates, states."""
