"""Column functions: text, links, review diffs, geometry, images."""
