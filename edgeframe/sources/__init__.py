"""Where graphs and specifications come from."""
