"""Scalar functions: nucleotides, qualities, identifiers, k-mers; as Column expressions and as numpy twins."""
