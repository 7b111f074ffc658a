"""Physical-plan helpers (skew, lineage) and the end-to-end detection plan."""
