"""Where tables come from and go to: structure files, point tables, writers."""
