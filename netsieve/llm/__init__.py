"""Corpus preparation operators for training data: filtering, deduplication,
scoring, extraction, mixing, packing and storage of tokenised documents."""
