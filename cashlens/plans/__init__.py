"""Registered queries: each pairs a DataFrame plan with the same result stated in plain SQL."""
