"""Training-data operators: packing, chat formatting, decontamination, de-duplication, search, scans and scoring."""
