"""Column functions: names, tokens, tactic text, module paths."""
