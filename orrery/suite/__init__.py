"""Named queries over the standard tables, by subject."""
