"""Part of echofold."""
