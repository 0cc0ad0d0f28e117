"""Operators of a training-data pipeline over corpora."""
