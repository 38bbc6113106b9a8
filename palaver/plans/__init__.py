"""Whole runs: configuration, artefacts, checks, publishing."""
