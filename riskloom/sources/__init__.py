"""Ledgers: accounts and transactions from files, tables or a generator."""
