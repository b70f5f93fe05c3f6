"""Where records come from and where they are stored."""
