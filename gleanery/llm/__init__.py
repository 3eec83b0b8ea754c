"""Training-data operators: filtering, deduplication, decontamination, mixing.

Nothing outside this package imports it; deleting it leaves the rest working.
"""
