"""Operators for training-data pipelines: duplicates, decontamination, scoring, personal data, mixing."""
