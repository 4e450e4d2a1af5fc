"""Operators for preparing training text: search, packing, privacy, decontamination and de-duplication."""
