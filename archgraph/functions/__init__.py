"""Column functions: ids, paths, names, rules."""
