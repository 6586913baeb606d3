"""Streaming of chronofold."""
