"""Graph operators on edge DataFrames (src, dst, weight) — no driver-side graph."""
