"""Operators on texts and vectors for training data. Nothing else imports this subpackage."""
