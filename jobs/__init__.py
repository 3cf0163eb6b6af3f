"""Jobs to be run from a command line; each is a function of a session and paths."""
