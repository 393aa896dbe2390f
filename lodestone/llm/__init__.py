"""Training-data operators: classifiers, near-duplicates, PII, archives, mixing, tokens."""
