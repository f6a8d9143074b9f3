"""Where graphs come from: tables, files, source trees."""
