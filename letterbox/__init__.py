"""Letterbox."""
