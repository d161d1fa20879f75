"""Structure files as streams."""
