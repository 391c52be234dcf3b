"""Part of lanefold; see README.md for the operator map."""
