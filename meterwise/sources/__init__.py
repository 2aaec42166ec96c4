"""Where the logical input tables come from."""
