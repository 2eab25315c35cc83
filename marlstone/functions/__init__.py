"""Part of marlstone."""
