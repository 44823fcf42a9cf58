"""Readers of instrument, matrix, archive and ledger files as DataFrames."""
