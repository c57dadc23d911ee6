"""Preparing texts and source files for language models."""
