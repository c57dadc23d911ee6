"""Facts that arrive as a stream of files."""
