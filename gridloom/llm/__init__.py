"""Training-data operators: deduplication, decontamination, language ID, scoring, packing and scans."""
