"""Plans of chronofold."""
