"""Reading, mapping, merging and writing lender extracts."""
