"""Readers and writers of problem sets and generation logs."""
