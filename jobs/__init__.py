"""Runnable jobs: each has a command line, a settings file beside it and a function that takes a session."""
