"""Where operations come from and where they are kept."""
