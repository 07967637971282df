"""Operators for preparing training text: rules, scores, packing, de-duplication, search, secrets and byte-level ids."""
