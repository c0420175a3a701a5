"""Training-data operators: dedup, decontamination, classifiers, packing, token counts and WARC files."""
