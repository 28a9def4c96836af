"""Marts over streams. An addition of this library."""
