"""Operators for text corpora and for the sketches that go with them. Nothing outside this package imports it."""
