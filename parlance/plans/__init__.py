"""Whole metrics and runs, composed of operators."""
