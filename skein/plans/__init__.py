"""Plan helpers: scratch tables and iteration."""
