"""Reports: each turns captures, lines or files into rows that can be checked, and rendered to text last."""
