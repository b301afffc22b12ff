"""Ledger analytics over many accounts at once, written as DataFrame operators."""
