"""Column functions: text rules, page arithmetic, maps and times."""
