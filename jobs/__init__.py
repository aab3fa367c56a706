"""Runnable jobs: each has a function that takes a session and a command line (python -m jobs.<name> --config jobs/<name>.json ...)."""
