"""DataFrame operators: each takes and returns DataFrames and knows no storage."""
