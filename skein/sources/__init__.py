"""Where edges come from."""
