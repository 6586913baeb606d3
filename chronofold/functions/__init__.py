"""Functions of chronofold."""
