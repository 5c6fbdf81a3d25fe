"""Training-data operators: tokens, fingerprints, templates, classifiers, packing, archives, de-duplication."""
