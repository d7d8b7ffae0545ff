"""Column functions: text extraction, condition analysis, rule-driven classification."""
