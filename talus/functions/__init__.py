"""Column functions: text, dates, hashes, classification and scoring formulas."""
