"""The reference's three jobs as single DataFrame plans (Q1-Q3)."""
