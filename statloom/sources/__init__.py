"""Readers: text corpora, bitmaps, delimited rows, paired feeds."""
