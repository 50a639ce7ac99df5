"""Operators for preparing text corpora: licences, near copies, packing, contamination, personal data, language, quality."""
