"""Training-data operators: decontamination, scoring, near-duplicates, archives, filters, formats."""
