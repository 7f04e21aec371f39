"""Compositions of operators into whole retrieval plans."""
