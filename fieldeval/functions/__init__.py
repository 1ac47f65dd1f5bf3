"""Column functions: text cleaning, parsing, comparison and small value rules."""
