"""Readers and writers of bars, metrics and ledgers."""
