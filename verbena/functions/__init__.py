"""Column selectors, group-aware expressions and scalar functions."""
