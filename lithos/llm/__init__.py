"""Training-data operators: dedup, decontamination, classifiers, packing, token output."""
