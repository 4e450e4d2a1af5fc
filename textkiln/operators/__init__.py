"""Operators over documents, lines, sessions, facts and run logs."""
