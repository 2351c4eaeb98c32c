"""Operators over panels, filings and scores: DataFrame in, DataFrame out."""
