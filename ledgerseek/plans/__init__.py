"""Driver-side planning: filter language, ranges, cursors, segments."""
