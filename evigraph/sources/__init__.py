"""Readers, source adapters and the synthetic corpus."""
