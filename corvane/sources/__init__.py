"""Readers of files and of run folders."""
