"""Runnable jobs: each file has a function of a session and paths, and a command line that starts a session for it."""
