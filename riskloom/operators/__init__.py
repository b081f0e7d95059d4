"""Composable operators over ledgers."""
