"""Column-returning helpers (no actions, no state)."""
