"""Operators a training-data pipeline needs: dedup, classification, mixing, tokens, archives."""
