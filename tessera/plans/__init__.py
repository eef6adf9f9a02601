"""Whole programs: inference, export, training, blocking benchmark."""
