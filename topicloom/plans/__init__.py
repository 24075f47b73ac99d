"""Compositions of operators into whole stages."""
