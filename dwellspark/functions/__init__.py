"""Column functions: text, dates, geography, vectors, signals, fuzzy matching."""
