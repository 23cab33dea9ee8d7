"""Training-data operators: deduplication, decontamination, language, packing, search, licences, token counts, toxicity."""
