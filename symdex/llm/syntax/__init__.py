"""Syntax repair by error-correcting chart parsing."""
