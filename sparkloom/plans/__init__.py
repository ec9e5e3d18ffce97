"""From clauses to data frames."""
