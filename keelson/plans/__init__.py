"""Jobs built from the operators, and the catalogue of test queries."""
