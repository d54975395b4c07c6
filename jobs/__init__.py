"""Jobs that keep an index of passages and evaluate answers from it; each has a command line and a config file."""
