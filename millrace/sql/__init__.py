"""SQL front door: splitting, dispatch, name resolution and rewrites."""
