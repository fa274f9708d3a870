"""Column functions: text, money, dates and rates."""
