"""Column-level functions: path text, name rules, masks and per-operation rules."""
