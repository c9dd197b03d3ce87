"""Where captured text, files and listings come from. Nothing here runs a command."""
