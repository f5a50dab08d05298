"""Readers, path rules and stream codecs."""
