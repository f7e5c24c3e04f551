"""Training-data operators: formatting, tokens, decontamination, near-dedup, classifiers, mixing and rules."""
