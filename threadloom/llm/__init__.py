"""Training-data operators: archives, sharding, scanning, tokenising, deduplication, decontamination, language ID.

Nothing else in the library imports this subpackage.
"""
