"""Sources of chronofold."""
