"""Operators for preparing training text: language, pairing, tokens, alignment, overlap, splitting, packing, normal forms."""
