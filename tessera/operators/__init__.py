"""Operators on records, pairs and scores: DataFrame -> DataFrame."""
