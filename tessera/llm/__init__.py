"""Training-data operators: chat formatting, WARC revisits, mixing, deduplication, quality, licences, decontamination, language-model scores.

Nothing else in the library imports this subpackage.
"""
