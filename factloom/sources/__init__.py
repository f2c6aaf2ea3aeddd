"""Readers that turn files into addressable fragments."""
