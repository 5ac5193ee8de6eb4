"""Whole jobs: preparing a corpus, the starting topics, the fit, scoring, output."""
