"""The command line: one query, a prompt, an HTTP service, or a tool server on standard input and output."""
