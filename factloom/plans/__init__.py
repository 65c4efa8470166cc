"""Plans: the operators applied to the project's tables, with production parameters, and their SQL."""
