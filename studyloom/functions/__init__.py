"""Column functions: game rules, scoring and text shaping."""
