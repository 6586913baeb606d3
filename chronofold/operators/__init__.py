"""Operators of chronofold."""
