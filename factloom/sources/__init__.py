"""Where facts come from: source trees, change logs, notes."""
