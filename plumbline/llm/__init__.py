"""Training-data operators: near-duplicate removal, formatting, filtering,
packing, archive and media columns, decontamination and toxicity scoring.

The subpackage stands alone: it imports nothing from the rest of the library,
and nothing outside imports it.
"""
