"""Operators over DataFrames: de-duplication, matching, clustering, rates, projection, life cycle."""
