"""Operators for training data: term weights, similarity clusters, main content, term counts, co-occurrence, packing, leaked test items, splitting."""
